"""Sharding by a Feistel permutation of global row numbers; DataFrame functions only.

Rows get gapless numbers in an order that depends on their values alone (bucket of a hash, then doc_id, checksum,
size). Rows alike in all of these are counted, numbered as one and dealt out again, so that none of them meet. A permutation of [0, n) moves number i to p(i); shard = p(i) mod k, slot = p(i) div k. Shard and slot of a
number can thus be computed anywhere from (n, seed), and row counts of shards differ by one at most.

The permutation is an alternating Feistel network over Z_a x Z_b with a * b just above n, made exact by cycle
walking: values from n on are permuted again until they fall below n. At most a * b - n + 1 <= a steps are needed,
and only about one row in sqrt(n) needs any, so the walk costs O(1) a row on average and always ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged, text_or_empty

ROUNDS = 6
#: Buckets in which rows are numbered: their counts are gathered on the driver, so their number is bounded (2 MB).
MAX_BUCKETS = 1 << 17
ROWS_A_BUCKET = 50_000
#: Rows alike that one row of a step stands for; those of more rows are dealt out in parts.
PART = 10_000


def domain(n: int) -> tuple[int, int]:
    """a and b, nearly equal, with n <= a * b < n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def network(x: str, n: int, seed: int) -> str:
    """SQL of one pass of the network on 0 <= x < a * b: even rounds move the left half, odd ones the right."""
    a, b = domain(n)
    half = lambda i, other, m: f"pmod(xxhash64({seed}L, {i}, {other}), {m}L)"
    left, right = f"(s div {b}L)", f"(s % {b}L)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), {x}, (s, i) -> if(i % 2 = 0,"
        f" (({left} + {half('i', right, a)}) % {a}L) * {b}L + {right},"
        f" {left} * {b}L + ({right} + {half('i', left, b)}) % {b}L))"
    )


def with_permuted(df: DataFrame, number: str, out: str, n: int, seed: int) -> DataFrame:
    """df with p(number) in the column out."""
    if n <= 1:
        return df.withColumn(out, F.col(number))
    a, _ = domain(n)
    walk = f"aggregate(sequence(1, {a}), pal_first, (w, t) -> if(w < {n}L, w, {network('w', n, seed)}))"
    return df.withColumn("pal_first", F.expr(network(number, n, seed))).withColumn(out, F.expr(f"if(pal_first < {n}L, pal_first, {walk})")).drop("pal_first")


def numbered(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The keys of all rows with a gapless column pal_row from 0, set by their values; rows alike are exchangeable.

    Rows alike are counted with map-side combining; a bucket's window runs over distinct ones."""
    buckets = max(1, min(MAX_BUCKETS, -(-n // ROWS_A_BUCKET)))
    alike = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("pal_n"))
    alike = staged(alike.withColumn("pal_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "alike")
    offsets, at = [], 0
    for r in sorted(alike.groupBy("pal_bucket").agg(F.sum("pal_n").alias("n")).collect()):
        offsets.append((r["pal_bucket"], at))
        at += r["n"]
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets, "pal_bucket int, pal_offset long"))
    before = F.sum("pal_n").over(W.partitionBy("pal_bucket").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)) - F.col("pal_n")
    placed = alike.withColumn("pal_before", before).join(offset, "pal_bucket").select(*keys, "pal_n", (F.col("pal_offset") + F.col("pal_before")).alias("pal_row"))
    few = placed.filter("pal_n = 1").drop("pal_n")
    parts = placed.filter("pal_n > 1").select(*keys, "pal_row", "pal_n", F.explode(F.expr(f"sequence(0L, pal_n - 1, {PART}L)")).alias("pal_at"))
    parts = parts.repartition(*keys, "pal_at").select(*keys, "pal_row", F.explode(F.expr(f"sequence(pal_at, least(pal_at + {PART - 1}, pal_n - 1))")).alias("pal_at"))
    return few.unionByName(parts.select(*keys, (F.col("pal_row") + F.col("pal_at")).alias("pal_row")))


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """For each row: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in a shard).

    Row counts of shards differ by one at most. Null texts count as empty; null and repeated doc_ids are rows like
    others. Rows alike in doc_id, checksum and size are exchangeable. An empty table gives an empty result; other
    columns are ignored. Texts of any length count whole and aren't shuffled: only doc_id, size and checksum are.
    """
    rows = staged(docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty()).alias("text_crc32")), "sizes")
    n = rows.count()
    out = with_permuted(numbered(rows, ["doc_id", "text_crc32", "size"], n), "pal_row", "pal_at", n, seed)
    return out.select("doc_id", "size", "text_crc32", F.pmod("pal_at", F.lit(shards)).cast("int").alias("shard"), F.expr(f"pal_at div {shards}L").alias("slot"))
