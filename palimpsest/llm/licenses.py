"""License scans: normalised text compared to licence templates by the Dice coefficient over sets of word bigrams.

Per template, a text's candidate windows are found where its bigrams lie dense: a bigram of the template adds 2 - t to a
running sum, any other one takes t away (t is the threshold), and a window goes from where the sum last stood lowest to
where it is highest. A window of s distinct bigrams can reach t only with templates of s * t / (2 - t) to s * (2 - t) / t
bigrams: templates of which fewer bigrams occur than these bounds ask for are pruned before windows are made, and windows
outside the bounds before they are compared. So a notice is found wherever it stands: in a line, wrapped, in a comment
block, above code, inside a sentence. Of windows that overlap only the best one's licence counts.

Covered by the fixed list: notices and short statements of Apache-2.0, MIT, BSD-2-Clause, BSD-3-Clause, ISC, GPL-2.0,
GPL-3.0, LGPL-2.1, LGPL-3.0, AGPL-3.0, MPL-2.0, CC-BY, CC-BY-SA and CC-BY-NC 4.0, CC0-1.0 and the Unlicense; of these MIT,
ISC and BSD whole. The long bodies of Apache, GPL, MPL, CC licences and the Unlicense are not templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import text_or_empty

THRESHOLD = 0.8
# Licence texts, notices and statements as they are publicly recommended, by SPDX identifier.
_GRANT = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WAIVER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WAIVER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", _GRANT.format(":", "Affero", ",", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", " ".join([_BSD, _BSD_CLAUSES, _BSD_WAIVER])),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", " ".join([_BSD, _BSD_CLAUSES, _BSD_THIRD, _BSD_WAIVER])),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", _GRANT.format(";", "", ";", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GRANT.format(":", "", ",", "3")),
    ("ISC", _ISC),
    ("ISC", " ".join([_ISC, _ISC_WAIVER])),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", _GRANT.replace("program", "library").format(";", "Lesser", ";", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", _GRANT.format(":", "Lesser", ",", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", " ".join([_MIT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS])),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

_OTHER = re.compile(r"[^a-z0-9]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits."""
    return _OTHER.sub(" ", text.lower()).split()


def bigrams(parts: list[str]) -> set[tuple[str, str]]:
    return set(zip(parts, parts[1:]))


class Scanner:
    def __init__(self, templates=None, threshold: float = THRESHOLD):
        self.threshold, self.cost = threshold, round(threshold * 1000)
        self.templates = [(name, bigrams(words(t))) for name, t in templates or TEMPLATES]
        self.containing: dict[tuple[str, str], list[int]] = {}
        for i, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.containing.setdefault(g, []).append(i)

    def windows(self, hits: list[int]) -> Iterator[tuple[int, int]]:
        """First and last bigram of each window, of the places at which a template's bigrams stand."""
        least, best, first, last = None, 0, 0, 0
        for k, i in enumerate(hits):
            level = 2000 * k - self.cost * i  # in thousandths, before this hit
            if least is None or level <= least:
                if least is not None:
                    yield first, last
                least, first, best = level, i, None
            if best is None or level > best:
                best, last = level, i
        if least is not None:
            yield first, last

    def found(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(licence, Dice coefficient, the template's bigrams, first word, last word) of windows that reach the threshold."""
        parts = words(text)
        t = self.threshold
        places: dict[int, list[int]] = {}
        for i, g in enumerate(zip(parts, parts[1:])):
            for k in self.containing.get(g, ()):
                places.setdefault(k, []).append(i)
        out = []
        for k, hits in places.items():
            name, own = self.templates[k]
            if len(hits) * (2 - t) < len(own) * t:
                continue
            for first, last in self.windows(hits):
                if (last - first + 1) * (2 - t) < len(own) * t:
                    continue
                grams = bigrams(parts[first : last + 2])
                if len(grams) * t <= len(own) * (2 - t):
                    dice = 2 * len(grams & own) / (len(grams) + len(own))
                    if dice >= t:
                        out.append((name, dice, len(own), first, last + 1))
        return out

    def matches(self, text: str) -> dict[str, float]:
        """By licence: its best coefficient. A window counts unless a better one of another licence overlaps it: by
        coefficient, then by the template's size, then by name."""
        found = self.found(text)
        best: dict[str, float] = {}
        for name, dice, size, first, last in found:
            if not any(n != name and f <= last and first <= x and (-d, -s, n) < (-dice, -size, name) for n, d, s, f, x in found):
                best[name] = max(best.get(name, 0.0), dice)
        return best


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: doc_id, licenses (sorted, comma-joined; empty if none), best_license and best_dice (null if none; on a
    tie the alphabetically first).

    Null texts count as empty. Null or repeated doc_ids stay rows of their own; an empty table gives an empty result;
    other columns are ignored. Texts of any length are searched whole, in time in proportion to their words. Nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            found = [scanner.matches(t.as_py()) for t in batch.column(1)]
            best = [min(m, key=lambda k: (-m[k], k)) if m else None for m in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([",".join(sorted(m)) for m in found], pa.string()), pa.array(best, pa.string()),
                pa.array([m[b] if m else None for m, b in zip(found, best)], pa.float64())], ["doc_id", "licenses", "best_license", "best_dice"])

    rows = on_workers(docs).select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licenses string, best_license string, best_dice double")
