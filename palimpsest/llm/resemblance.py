"""Near-duplicates by the Jaccard similarity of the sets of word shingles: candidates by min-hashes, each checked exactly.

BANDS keys of WIDTH min-hashes each stand for a text; two texts of similarity s share no key with probability
(1 - s ** WIDTH) ** BANDS: 3e-6 at 0.8, less above. Nothing else is left to chance: texts that share a key are compared by
their whole sets. Copies collapse first, and keys of one text alone are dropped before any set is made. A first round
compares each text with others under the smallest text that shares a key with it, in cells of about CELL; a second
compares what still lies apart under a shared key, in pairs of blocks of CELL texts, without blocks that are already one. Texts whose SimHash fingerprints link (simhash.py) are linked whatever their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import bloom_pages, bloom_test, filter_bits, lookup, packed, release, staged, text_or_empty
from .simhash import components, fingerprint
from .simhash import links as fingerprint_links

BANDS, WIDTH = 24, 4
#: Texts compared at once, and shingles hashed at once.
CELL, CHUNK = 256, 1 << 12
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * WIDTH, np.uint64)[:, None]
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * WIDTH, np.uint64)[:, None] | np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, WIDTH), np.uint64) | np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the runs of so many words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(line[b:e]) for b, e in zip(begins, ends[words - 1 :].tolist())], np.uint64))


def keys(grams: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of hashes."""
    least = np.full(BANDS * WIDTH, ~np.uint64(0))
    for at in range(0, len(grams), CHUNK):
        least = np.minimum(least, ((grams[at : at + CHUNK] ^ _XOR) * _TIMES).min(1))
    x = least.reshape(BANDS, WIDTH)
    return (((x ^ (x >> np.uint64(29))) * _MIX).sum(1, dtype=np.uint64) * _MIX[:, 0]).view(np.int64)


def alike(sets: list[np.ndarray], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links (pairs of positions) of sets that are similar enough and whose labels no earlier link has joined."""
    names = {}
    label = np.array([names.setdefault(x, len(names)) for x in labels])
    sizes = np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int64)
    links = []
    for i in range(len(sets)):
        apart = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        apart[:i] = False
        if not apart.any():
            continue
        own = ids[begins[i] : begins[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], begins)
        mark[own] = 0
        for j in np.nonzero(apart & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))[0].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (hash of the text), fp (its fingerprint) and keys of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.concatenate([keys(shingles(t.as_py(), words)) for t in batch.column(2)]) if batch.num_rows else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), held], ["doc_id", "h", "fp", "keys"])

    rows = on_workers(docs).select("doc_id", F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(h, grams): the shingles of the texts whose hash is in wanted (h, distinct). Other texts are not shuffled, but for
    false positives of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["h", "grams"])

    bits = filter_bits(wanted.count())
    pages = staged(bloom_pages(wanted, bits, 1), "wanted-filter")
    rows = docs.select(F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    maybe = bloom_test(rows, "h", pages, bits, "pal_maybe").filter("pal_maybe").groupBy("h").agg(F.first("text").alias("text"))
    return on_workers(maybe.join(wanted, "h", "left_semi").select("h", "text")).mapInArrow(run, "h long, grams binary")


def compared(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the labels of similar texts within each cell (k, i, j) of rows (h, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out() -> pa.RecordBatch:
            found = alike([np.frombuffer(g, np.uint64) for _, _, g in held], [x for _, x, _ in held], similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            k, i, j, h, label, grams = batch.columns
            for at, now in enumerate(zip(k.to_pylist(), i.to_pylist(), j.to_pylist())):
                if now != cell:
                    if held:
                        yield out()
                    cell, held = now, []
                held.append((h[at].as_py(), label[at].as_py(), grams[at].as_py()))
        if held:
            yield out()

    rows = cells.join(sets, "h").select("k", "i", "j", "h", "label", "grams")
    return on_workers(rows).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "label", "h").mapInArrow(run, "a long, b long")


def first_cells(buckets: DataFrame, total: int) -> DataFrame:
    """Each text with the smallest text that shares a key with it; those of many texts are dealt out, each part with it."""
    nearest = staged(buckets.groupBy("h").agg(F.min("c").alias("k")).filter("k <> h"), "nearest")
    sizes = nearest.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / CELL)).cast("long").alias("i")
    members = staged(lookup(nearest, sizes, "k", "n", total).select("k", part, F.lit(0).cast("long").alias("j"), "h"), "cells")
    release(nearest)
    return members.unionByName(members.select("k", "i", "j", F.col("k").alias("h")).distinct()).withColumn("label", F.col("h"))


def second_cells(buckets: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """The texts of keys that hold several labels, in pairs of blocks of about CELL texts. A label of many texts has blocks of
    its own, which aren't paired with each other; the others are dealt out by label. Cells are named (k, i, j)."""
    labelled = staged(buckets.join(labels, buckets.h == labels.node, "left").select("k", "h", F.coalesce("label", "h").alias("label")), "labelled")
    per = labelled.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") < CELL
    of_key = per.groupBy("k").agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)).alias("rest")).filter("labels > 1")
    per = staged(per.join(of_key, "k"), "labels-of-keys")
    deal = F.greatest(F.ceil(F.col("rest") / CELL), F.lit(1))
    # a block is (own, part): the label and a part of its texts, or null and a part of the labels
    own = F.when(~few, F.col("label")).alias("own")
    placed = lookup(labelled, per, ["k", "label"], "n", total).select(
        "k", "h", "label", own, F.when(few, F.pmod(F.xxhash64("label"), deal)).otherwise(F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / CELL))).cast("long").alias("part"))
    rows = staged(placed.withColumn("block", F.xxhash64("own", "part")), "blocks")
    blocks = rows.select("k", "own", "block").distinct()
    pairs = blocks.select("k", F.col("own").alias("a"), F.col("block").alias("i")).join(blocks.select("k", F.col("own").alias("b"), F.col("block").alias("j")), "k")
    pairs = pairs.filter("i <= j and (a is null or b is null or a <> b)")
    return pairs.select("k", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(rows, ["k", "block"]).select("k", "i", "j", "h", "label")


def by_fingerprint(classes: DataFrame, errors: int) -> DataFrame:
    """(a, b): links of texts (h, fp) whose fingerprints are at most so many bits apart, by the first text of each."""
    first = staged(classes.groupBy("fp").agg(F.min("h").alias("b"), F.count(F.lit(1)).alias("pal_n")), "fingerprints")
    n = first.count()
    found = staged(fingerprint_links(first.select("fp"), n, errors), "links")
    one, two = first.select(F.col("fp").alias("a"), F.col("b").alias("x")), first.select(F.col("fp").alias("b"), F.col("b").alias("y"))
    apart = found.join(one, "a").select("b", "x").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = lookup(classes.select("h", "fp"), first.filter("pal_n > 1"), "fp", "pal_n", n).filter("h <> b").select(F.col("h").alias("a"), "b")
    return apart.unionByName(same)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """For each distinct text whose component has several rows: h (its hash), pal_n (its rows), and keep_h and keep_id, the
    text and doc_id of the row that stays: the smallest doc_id (null last), then the smallest hash."""
    all_keys = sketches(docs, words).groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("pal_n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = staged(all_keys, "classes")
    keyed = classes.select("h", F.explode("keys").alias("k"))
    shared = staged(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("c")).filter("n > 1"), "shared")
    total = BANDS * classes.count()
    buckets = staged(lookup(keyed, shared, "k", "n", total).select("k", "h", "c"), "buckets")
    wanted = staged(buckets.select("h").distinct(), "wanted")
    sets = staged(sets_of(docs, wanted, words), "sets")
    links = staged(compared(first_cells(buckets, total), sets, similarity).unionByName(by_fingerprint(classes, errors)), "links")
    joined = components(links)
    more = staged(compared(second_cells(buckets, joined, total), sets, similarity), "links")
    release(joined, wanted, shared)
    labels = components(links.unionByName(more))
    release(sets, buckets, links, more)
    labelled = staged(classes.join(labels, classes.h == labels.node, "left").select("h", "first", "pal_n", F.coalesce("label", "h").alias("label")), "labels")
    release(classes, labels)
    best = F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("h"))).alias("best")
    whole = staged(labelled.groupBy("label").agg(best, F.sum("pal_n").alias("rows"), F.count(F.lit(1)).alias("pal_m")).filter("rows > 1"), "whole")
    return lookup(labelled, whole, "label", "pal_m", labelled.count()).select("h", "pal_n", F.col("best.h").alias("keep_h"), F.col("best.first").alias("keep_id"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """One row of each component of texts linked by this similarity or more, or by so many bits of SimHash or fewer, whole.

    Rows are told apart by text and doc_id, so null and repeated doc_ids are rows like others; of rows alike in both, any
    one stays. Null texts count as empty, and texts without a word are alike. An empty table gives an empty result; other
    columns stay, whatever their names; texts of any length count whole. Most rows don't shuffle: a bounded Bloom filter of
    the texts that go tells which rows may have to.
    """
    found = near_duplicates(docs, words, similarity, errors).filter("h <> keep_h or pal_n > 1")
    gone = staged(found.select(F.col("h").alias("pal_h"), "pal_n", F.col("keep_h").alias("pal_keep_h"), F.col("keep_id").alias("pal_keep_id")), "gone")
    bits = filter_bits(gone.count())
    pages = staged(bloom_pages(gone.select(F.col("pal_h").alias("h")), bits, 1), "gone-filter")
    tested = bloom_test(packed(docs, pal_id=F.col("doc_id"), pal_h=F.xxhash64(text_or_empty())), "pal_h", pages, bits, "pal_maybe")
    maybe = staged(tested.filter("pal_maybe").select("row", "pal_id", "pal_h"), "candidates")
    kept = lookup(maybe, gone, "pal_h", "pal_n", maybe.count(), "left")
    one = kept.filter((F.col("pal_h") == F.col("pal_keep_h")) & F.col("pal_id").eqNullSafe(F.col("pal_keep_id"))).dropDuplicates(["pal_h"])
    alone = kept.filter("pal_n is null")  # false alarms
    return tested.filter("not pal_maybe").select("row.*").unionByName(alone.select("row.*")).unionByName(one.select("row.*"))
