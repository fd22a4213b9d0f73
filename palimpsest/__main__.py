"""python -m palimpsest STORE VERB ..."""

import sys

from .api import command
from .session import session
from .store import Store

sys.exit(command(Store(session(), sys.argv[1]), sys.argv[2:]))
