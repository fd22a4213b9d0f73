"""Near-duplicates by SimHash: fingerprints linked by a self-join of binary tries.

Distinct fingerprints (copies collapse first) are cut into m blocks of bits; two that differ in at most `errors` bits
agree in m - errors blocks at least, so each fingerprint goes once to each choice of that many blocks, keyed by their
bits. m follows the number of fingerprints, so that keys stay selective; any m finds every link. Under each key stands
a binary trie over the other bits. It is joined with itself: pairs of nodes descend together and add up the bits in
which they differ, and a pair is pruned once they exceed the budget, or once both nodes are in one component already.
Only links that join two components leave a task (fewer than fingerprints came in), and the components are closed by
alternating star contractions between written tables.

A key with over HEAVY fingerprints isn't joined in one task: the bits that its key leaves free are cut into errors + 1
blocks, of which two fingerprints that link share one, so that its trie falls apart into that many sets of smaller ones,
and so on until none is heavy or so few bits are free that none can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import bloom_pages, bloom_test, filter_bits, lookup, packed, release, staged, text_or_empty

BITS = 64
#: Shingles counted at once, and node pairs that descend at once.
CHUNK, PAIRS = 1 << 16, 1 << 18
#: Distinct fingerprints of one key that a task joins at most; it holds a few hundred bytes for each.
HEAVY = 1 << 17


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half the XXH64 hashes of the text's shingles, repeats included; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # on bytes: A-Z alone, and white space of ASCII alone
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begins), CHUNK):
        h = np.array([xxh64_intdigest(line[b:e], seed) for b, e in zip(begins[at : at + CHUNK], ends[at : at + CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return on_workers(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks(n: int, errors: int) -> int:
    """Into how many blocks n fingerprints are cut: more of them make longer keys, but more copies."""
    for m in range(errors + 1, 2 * errors + 1):
        if n <= 64 << (BITS * (m - errors) // m):
            return m
    return 2 * errors


def masks(m: int, errors: int) -> list[int]:
    """Bits of each choice of m - errors blocks, as a signed long."""
    edges = [BITS * i // m for i in range(m + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << (BITS - edges[i + 1]) for i in range(m)]
    out = [sum(block[i] for i in c) for c in combinations(range(m), m - errors)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def join_trie(fps: np.ndarray, groups: np.ndarray, errors: int) -> np.ndarray:
    """Links (pairs of positions) that join the components of fingerprints of one group with at most so many
    different bits. fps is sorted within equal groups, which are contiguous; fingerprints of a group are distinct."""
    n = len(fps)
    parent = list(range(n))
    links: list[np.ndarray] = []
    label = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        new = []
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                new.append((x, y))
        if new:
            links.append(np.array(new))

    begins = np.nonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))[0] if n else np.zeros(0, np.int64)
    ends = np.concatenate([begins[1:], [n]]) if n else begins
    many = ends - begins > 1
    # a stack of frontiers: node pairs as ranges [ul, uh) and [vl, vh) of positions, the bit they descend on, errors so far
    z = np.zeros(many.sum(), np.int64)
    stack = [(begins[many], ends[many], begins[many], ends[many], z + BITS - 1, z)]
    known = 0
    while stack:
        ul, uh, vl, vh, bit, err = stack.pop()
        if len(ul) > PAIRS:
            whole = ul, uh, vl, vh, bit, err
            stack += [tuple(c[at : at + PAIRS] for c in whole) for at in range(PAIRS, len(ul), PAIRS)]
            ul, uh, vl, vh, bit, err = (c[:PAIRS] for c in whole)
        single = (uh - ul == 1) & (vh - vl == 1)
        i, j = ul[single], vl[single]
        if len(i):
            near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= errors)
            unite(i[near], j[near])
        # pairs whose fingerprints are all in one component already have nothing to add
        ul, uh, vl, vh, bit, err = (x[~single] for x in (ul, uh, vl, vh, bit, err))
        if len(links) > known:
            known, label = len(links), np.array(parent)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (change[ul] == change[uh - 1]) & (change[vl] == change[vh - 1]) & (label[ul] == label[vl])
        if one.any():
            ul, uh, vl, vh, bit, err = (x[~one] for x in (ul, uh, vl, vh, bit, err))
        if not len(ul):
            continue
        um, vm = _split(fps, ul, uh, bit), _split(fps, vl, vh, bit)
        same = (ul == vl) & (uh == vh)
        pairs = [(ul, um, vl, vm, err), (um, uh, vm, vh, err), (ul, um, vm, vh, err + 1), (um[~same], uh[~same], vl[~same], vm[~same], err[~same] + 1)]
        below = [bit - 1, bit - 1, bit - 1, bit[~same] - 1]
        grown = [(a, b, c, d, x, e) for (a, b, c, d, e), x in zip(pairs, below)]
        cols = [np.concatenate(c) for c in zip(*grown)]
        ul, uh, vl, vh, bit, err = cols
        self_single = (ul == vl) & (uh - ul == 1) & (vh - vl == 1)
        good = (uh > ul) & (vh > vl) & (err <= errors) & ~self_single
        if good.any():
            stack.append(tuple(c[good] for c in cols))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first position of each range whose fingerprint has the bit; the bits above are alike within a range."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1) << bit.astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = open_ & ((fps[np.minimum(mid, len(fps) - 1)] & mask) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def finer(mask: int, errors: int) -> list[int]:
    """A mask (signed long) with each of errors + 1 blocks of the bits that it leaves free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * i // (errors + 1) for i in range(errors + 2)]
    out = [mask % (1 << BITS) | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def cells(distinct: DataFrame, n: int, errors: int, heavy: int = HEAVY) -> DataFrame:
    """(t, k, fp): the keys under which fingerprints meet; any two at most so many bits apart share one.

    Keys of more than `heavy` fingerprints are found by counting with map-side combining and cut finer. There are at most
    n * choices / heavy of them, 40 bytes each, so that they may be broadcast."""
    spark = distinct.sparkSession
    paths = list(enumerate(masks(blocks(n, errors), errors)))
    under = lambda mask: F.col("fp").bitwiseAND(mask)
    now = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), under(F.lit(m)).alias("k")) for t, m in paths])).alias("x")).select("x.t", "x.k", "fp")
    out = None
    while paths:
        full = now.groupBy("t", "k").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > heavy).select("t", "k")
        paths = [(t, m) for t, m in paths if 1 << (BITS - (m % (1 << BITS)).bit_count()) > heavy]
        full = staged(full.filter(F.col("t").isin([t for t, _ in paths])), "heavy") if paths else None
        some = {r["t"] for r in full.select("t").distinct().collect()} if full is not None else set()  # at most one a choice
        if not some:
            return now if out is None else out.unionByName(now)
        light = now.join(F.broadcast(full), ["t", "k"], "left_anti")
        out = light if out is None else out.unionByName(light)
        down = [(t, t * (errors + 1) + i + 1_000_000, x) for t, m in paths if t in some for i, x in enumerate(finer(m, errors))]
        step = F.broadcast(spark.createDataFrame(down, "t long, t2 long, mask long"))
        now = staged(now.join(F.broadcast(full), ["t", "k"], "left_semi").join(step, "t").select(F.col("t2").alias("t"), under(F.col("mask")).alias("k"), "fp"), "finer")
        paths = [(t2, x) for _, t2, x in down]
    return out


def links(distinct: DataFrame, n: int, errors: int, heavy: int | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct, n of them) at most so many bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[np.ndarray] = []  # rows of keys that are complete
        open_: list[np.ndarray] = []  # rows of the last key, which may go on in the next batch

        def out() -> pa.RecordBatch:
            rows = np.concatenate(whole)
            fps, key = rows[:, 2].view(np.uint64), rows[:, :2]
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
            order = np.lexsort((fps, group))
            fps, group = fps[order], group[order]
            found = join_trie(fps, group, errors)
            s = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(s[found[:, 0]]), pa.array(s[found[:, 1]])], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            ends = np.nonzero((rows[1:, :2] != rows[:-1, :2]).any(1))[0] + 1
            last = ends[-1] if len(ends) else 0
            if open_ and (last or (open_[-1][-1, :2] != rows[0, :2]).any()):
                whole += open_
                open_ = []
            if last:
                whole.append(rows[:last])
            open_.append(rows[last:])
            if sum(map(len, whole)) >= CHUNK:
                yield out()
                whole = []
        whole += open_
        if whole:
            yield out()

    keyed = cells(distinct, n, errors, heavy or HEAVY)
    return on_workers(keyed).repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of an edge (a, b).

    Alternating star contractions: each node's larger neighbours go to its least neighbour, then its smaller ones.
    Rounds end when the edges are stars. Each round's edges are a written table.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = staged(now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "stars")
        large = _star(both, F.col("b") > F.col("a"))
        turned = staged(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        small = _star(turned, F.lit(True))
        following = staged(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        heads = following.select(F.col("b").alias("a")).distinct()
        done = following.groupBy("a").count().filter("count > 1").isEmpty() and following.join(heads, "a", "left_semi").isEmpty()
        release(now, both, turned)
        now = following
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _star(edges: DataFrame, move) -> DataFrame:
    """Edges (a written table) from each node's neighbours (those that `move` picks, and the node itself) to the least of both."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("pal_n"))
    moved = lookup(edges, least, "a", "pal_n", edges.count()).filter(move).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b")


def near_duplicates(docs: DataFrame, words: int = 4, errors: int = 4) -> DataFrame:
    """For each row: doc_id, fp (signed long), component_id (the smallest doc_id reachable over links), component_size.

    Fingerprints link at `errors` or fewer differing bits; those of texts without a word are zero and link like others.
    Null texts count as empty. A null doc_id is no component_id unless its component has no other. Rows that repeat a
    doc_id are rows of their own. An empty table gives an empty result; other columns are ignored. A text of any length
    counts whole; its shingles are counted CHUNK at a time.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("pal_n")), "classes")
    n = classes.count()
    found = staged(links(classes.select("fp"), n, errors), "links")
    labels = components(found)
    labelled = staged(classes.join(labels, classes.fp == labels.node, "left").select("fp", "first", "pal_n", F.coalesce("label", "fp").alias("label")), "labels")
    release(classes, found)
    whole = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("pal_n").alias("component_size"), F.count(F.lit(1)).alias("pal_m"))
    by_fp = staged(lookup(labelled, whole, "label", "pal_m", n).select("fp", "pal_n", "component_id", "component_size"), "components")
    release(labelled)
    return lookup(rows, by_fp, "fp", "pal_n", rows.count()).select("doc_id", "fp", "component_id", "component_size")


def deduplicate(docs: DataFrame, words: int = 4, errors: int = 4) -> DataFrame:
    """The rows of docs, whole, whose doc_id is their component's component_id.

    Most rows don't shuffle: a bounded Bloom filter of the doc_ids that go tells which rows may have to; only those meet
    the exact list. Rows that share a doc_id stay or go together; rows with a null doc_id can't be told apart and stay.
    Null texts count as empty. An empty table gives an empty result; other columns stay, whatever their names.
    """
    found = near_duplicates(docs, words, errors)
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    gone = staged(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("gone")).agg(stays.alias("stays")).filter("not stays").select("gone"), "gone")
    bits = filter_bits(gone.count())
    pages = staged(bloom_pages(gone.select(F.xxhash64("gone").alias("h")), bits, 1), "gone-filter")
    tested = bloom_test(packed(docs, id=F.col("doc_id"), h=F.xxhash64("doc_id")), "h", pages, bits, "maybe")
    exact = tested.filter("maybe").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return tested.filter("not maybe").select("row.*").unionByName(exact.select("row.*"))
