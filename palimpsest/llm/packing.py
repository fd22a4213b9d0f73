"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Each task packs what it reads, so no row is shuffled. A document is cut at whole windows; the rest is cut into pieces
of at most PIECE tokens. Pieces fill blocks of BLOCK windows; a block is partitioned into k windows by differencing:
the two partial partitions with the widest spreads are merged, fullest against emptiest, until one is left.
Where a window would exceed the capacity, the block is partitioned again into one window more.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import text_or_empty

#: Most tokens of the pieces that differencing moves, and least of those that a tail is halved into.
PIECE, FINE = 512, 16
#: Windows of a block, and tokens left free in each so that its fullest window rarely exceeds the capacity.
BLOCK, SLACK = 32, 6

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts with nearly equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])] + [(0, [])] * (k - 1)))  # parts by falling sum, less the least one
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x + y, p + q if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))]
        both.sort(key=lambda t: -t[0])
        least = both[-1][0]
        both = [(x - least, p) for x, p in both]
        heapq.heappush(heap, (-both[0][0], i, both))
    return [p for _, p in heap[0][2]] if heap else [[] for _ in range(k)]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes in as few near-equal windows as differencing can fit; no window is empty."""
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        parts = difference(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A function from a text to its ids: those that the tokenizers library gives for this file without adding any.

    The file must be a byte-level BPE that splits by the one pattern, with merges in order of their ids; others raise. Then
    its ids are those of tiktoken with the vocabulary as ranks (several times faster than the library, which the tests
    compare them with), and its added tokens, such as <|endoftext|>, get their ids wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, {t["content"]: t for t in spec.get("added_tokens", ())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [model["vocab"].get(x + y, -1) for x, y in merges]
    plain = (
        model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges", "byte_fallback")) and made == sorted(made)
        and all(len(t) == 1 or t in added for t in model["vocab"].keys() - {x + y for x, y in merges})
        and not any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip")) and not any(x != y and x.startswith(y) for x in added for y in added))
    if not plain:
        raise ValueError(f"{path} is no plain byte-level BPE")
    import tiktoken
    from public_tokenizers import PATTERN

    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t: x["id"] for t, x in added.items()})
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def cuts(rest: int) -> list[int]:
    """Sizes of the pieces of rest tokens: near-equal ones of at most PIECE, the last halved down to FINE.

    Pieces of one size can't fill windows that aren't a multiple of it; the small ones let differencing even out.
    """
    count = -(-rest // PIECE)
    sizes = [rest * (j + 1) // count - rest * j // count for j in range(count)]
    while sizes and sizes[-1] >= 2 * FINE:
        last = sizes.pop()
        sizes += [last - last // 2, last // 2]
    return sizes


class Packer:
    """Packs documents one after another; pieces come out as windows fill."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pieces: list[tuple] = []
        self.held = 0
        self.full = BLOCK * (capacity - SLACK)

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            yield from self._emit([(doc_id, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        for size in cuts(n - at):
            end = at + size
            while at < end:
                take = min(end, at + self.full - self.held)
                self.pieces.append((doc_id, at, ids[at:take], n))
                self.held += take - at
                at = take
                if self.held == self.full:
                    yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for part in windows([len(p[2]) for p in self.pieces], self.capacity) if self.pieces else ():
            yield from self._emit([self.pieces[i] for i in sorted(part)])
        self.pieces, self.held = [], 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids), n, self.sequence, offset, ids.tobytes()
            offset += len(ids)
        self.sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents' ids (end_id after each) in sequences of at most capacity tokens.

    One row a piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset in the
    sequence (gapless from 0), ids (little-endian unsigned 32-bit). Null texts count as empty and give their end_id.
    Null or repeated doc_ids are packed as rows of their own. An empty table gives no pieces; other columns are ignored. A
    text of any length is cut into pieces; its ids are held whole by one task. Each task ends with a block that isn't full, so
    padding grows with the number of splits.
    sequence_ids are unique and rise within a task's range, but have gaps between tasks. A run repeats them as long
    as it reads the same splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(tokenizer_path), np.array([end_id], np.uint32)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in packer.add(doc_id, np.concatenate([encode(text.as_py()), end]).astype("<u4")):
                    rows.append(row)
                    held += row[2]
                if held >= 1 << 20:
                    yield out()
                    rows, held = [], 0
        rows.extend(packer.flush())
        if rows:
            yield out()

    return on_workers(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def with_crc32(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32(ids) -> int:
    """What with_crc32() gives, of a list of ids."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
