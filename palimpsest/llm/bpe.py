"""Byte-level BPE as a monoid: texts are encoded in halves, and neighbours are joined by encoding their seam again.

Encoding a text is a product over its parts: enc(ab) = join(enc(a), enc(b)). Leaves of LEAF_CHARS characters are encoded
by themselves. A join takes a window of WINDOW_CHARS to both sides of the seam and doubles a side until the tokens outside
it provably stay as they are; only the window is encoded again. Two proofs serve:

* Between matches of the pattern. A place where the kind of character changes (letter, number, space, other), but for a
  change from white space and one behind an apostrophe, always ends a match: no match spans it, the pattern never looks
  back, and what it looks ahead for (white space) has ended. So a window between two such places can be replaced.
* Within a long match. A sequence of BPE tokens is the encoding of its bytes if and only if each two neighbours are
  the encoding of their joint bytes. So a window of tokens can be replaced if it agrees with its neighbours.

Decoding joins bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import text_or_empty

#: Characters of a leaf of the text's tree, bytes of a leaf within one long match, ids of a leaf when decoding.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 64, 32, 64
#: Where a window begins to grow, to each side: characters, and tokens within a long match.
WINDOW_CHARS, WINDOW_TOKENS = 16, 4
#: A window of more characters is cut into its matches, and these are encoded in halves.
LONG_CHARS = 1024
#: Rows that are encoded before a batch goes out.
ROWS_A_BATCH = 256

# Where a match surely ends: between a letter, a number or a sign and a character of another kind. Beyond ASCII only letters
# count, and only where no version of Unicode could class the two characters alike.
_SPACE, _SIGN = r"\t\n\x0b\x0c\r\x20", r"!-/:-@\[-`{-~"
BREAK = rf"(?:[A-Za-z](?=[0-9{_SPACE}{_SIGN}])|[0-9](?=[A-Za-z{_SPACE}{_SIGN}])|[!-&(-/:-@\[-`{{-~](?=[A-Za-z0-9{_SPACE}])|[\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ](?=[0-9{_SPACE}]))"
FIRST, LAST = re.compile(BREAK), re.compile("(?s).*" + BREAK)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.piece = self.core._core_bpe.encode_ordinary, self.core._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.length = [len(b) for b in self.bytes_of]
        self.pattern = regex.compile(pattern)
        self.agrees = lru_cache(maxsize=1 << 16)(self._agrees)
        self.joins = 0  # seams joined so far

    # Texts -----------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its parts before and behind mid."""
        self.joins += 1
        w, found = WINDOW_CHARS, None
        while not (found := LAST.match(text, max(lo, mid - w), mid)) and mid - w > lo:
            w *= 2
        begin = found.end() if found else lo
        w = WINDOW_CHARS
        while not (found := FIRST.search(text, mid, min(hi, mid + w))) and mid + w < hi:
            w *= 2
        end = found.end() if found else hi
        length = self.length
        keep, size = len(a), len(text[begin:mid].encode())
        while size > 0:  # the break ends a token, so sizes come out even
            keep -= 1
            size -= length[a[keep]]
        skip, size = 0, len(text[mid:end].encode())
        while size > 0:
            size -= length[b[skip]]
            skip += 1
        return a[:keep] + self._window(text[begin:end]) + b[skip:]

    def _window(self, text: str) -> list[int]:
        if len(text) <= LONG_CHARS:
            return self.leaf(text)
        return [i for m in self.pattern.finditer(text) for i in self._match(m.group().encode())]

    # One long match ----------------------------------------------------------------------------------------------

    def _match(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.piece(piece)
        mid = len(piece) // 2
        return self._join_tokens(self._match(piece[:mid]), self._match(piece[mid:]))

    def _agrees(self, x: int, y: int) -> bool:
        return self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        if self.agrees(a[-1], b[0]):
            return a + b
        w = WINDOW_TOKENS
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            mid = self.piece(b"".join(self.bytes_of[t] for t in a[i:] + b[:j]))
            if (i == 0 or self.agrees(a[i - 1], mid[0])) and (j == len(b) or self.agrees(mid[-1], b[j])):
                return a[:i] + mid + b[j:]
            w *= 2

    # Ids ---------------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None) -> Codec:
    """The codec of a file of ranks (base64 token, rank). A pattern of your own must end matches where BREAK says so."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(path, "rb") as f:
        return Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, as tiktoken's encode_ordinary() gives them.

    Null texts count as empty: an empty array. Null or repeated doc_ids stay rows of their own; an empty table gives
    an empty result; other columns are ignored. A text of any length is one row and costs time in proportion to its length
    (times the depth of its tree where a match or a run of one kind goes on for long). Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(at, ROWS_A_BATCH)
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.array(x, np.int32) for x in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return on_workers(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with a column decoded: the bytes of its ids, of any number. A null array counts as an empty one,
    null or unknown ids raise; null and repeated doc_ids stay rows of their own, and an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(at, ROWS_A_BATCH)
                lists = part.column(1).fill_null([])
                ends, flat = lists.offsets.to_pylist(), lists.values.to_numpy()  # raises where an id is null
                texts = [own.decode(flat[lo:hi].tolist()) for lo, hi in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return on_workers(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
