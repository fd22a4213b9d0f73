"""Reads over append chains: states, ranges, chunks and listings.

A chain is the rows of one thread in order; a window over it replaces the walk to the root. Forests use forest.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon
from ..model import RECENT_DEFAULT, RECENT_MOST


def chain(keys: list[str], order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def states(rows: DataFrame, keys: list[str], order: str, message: str = "message") -> DataFrame:
    """rows with state: the canonical JSON of all messages up to each."""
    return rows.withColumn("state", canon.state(F.collect_list(message).over(chain(keys, order))))


def state_lengths(rows: DataFrame, keys: list[str], order: str, message: str = "message") -> DataFrame:
    """rows with state_len alone, from lengths: no state is built. Child = parent + 1 + its own length."""
    w = chain(keys, order)
    return rows.withColumn("state_len", canon.EMPTY_STATE_LEN + F.sum(F.octet_length(message)).over(w) + F.count(F.lit(1)).over(w) - 1)


def extents(rows: DataFrame, keys: list[str], order: str, message: str = "message") -> DataFrame:
    """(keys, ord, payload, st, len) of each thread's last state: framing, messages and commas with their first byte."""
    w = W.partitionBy(*keys).orderBy(order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    payload = F.concat(F.when(first, canon.OPEN).otherwise(","), F.col(message), F.when(last, canon.CLOSE).otherwise(""))
    out = rows.withColumn("payload", F.encode(payload, "UTF-8")).withColumn("len", F.octet_length("payload").cast("long"))
    return out.withColumn("st", F.sum("len").over(chain(keys, order)) - F.col("len")).select(*keys, F.col(order).alias("ord"), "payload", "st", "len")


def clip(payload: Column, st: Column, size: Column, lo: Column, hi: Column) -> Column:
    """The bytes of an extent that lie in [lo, hi)."""
    begin = F.greatest(lo - st, F.lit(0).cast("long"))
    return F.substring(payload, (begin + 1).cast("int"), F.greatest(F.least(hi - st, size) - begin, F.lit(0).cast("long")).cast("int"))


def read_ranges(parts: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, off, n) with bytes (hex) of each thread's state, or error `OutOfRange`; n = 0 reads nothing.

    An equi-join on the thread with the overlap as a residual: extents outside a range are dropped before bytes move."""
    total = parts.groupBy(*keys).agg(F.max(F.col("st") + F.col("len")).alias("total"))
    known = requests.join(total, keys, "left")
    bad = (F.col("off") < 0) | (F.col("n") < 0) | (F.col("off") + F.col("n") > F.col("total")) | F.col("total").isNull()
    hit = known.filter(~bad).join(parts, keys).filter((F.col("st") < F.col("off") + F.col("n")) & (F.col("st") + F.col("len") > F.col("off")))
    piece = F.struct("st", F.hex(clip(F.col("payload"), F.col("st"), F.col("len"), F.col("off"), F.col("off") + F.col("n"))).alias("h"))
    got = hit.groupBy(*keys, "off", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["h"]), "").alias("h"))
    out = known.join(got, [*keys, "off", "n"], "left")
    return out.select(*keys, "off", "n", F.when(bad, F.lit(None)).otherwise(F.coalesce("h", F.lit(""))).alias("bytes_hex"),
                      F.when(F.col("total").isNull(), "NotFound").when(bad, "OutOfRange").alias("error"))


def chunks(states: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, chunk_no, chunk_len, chunk_sha256) of each state cut into chunks of at most size bytes."""
    b = states.withColumn("b", F.encode("state", "UTF-8")).withColumn("n", F.octet_length("b"))
    b = b.filter("n > 0").select(*keys, "b", F.posexplode(F.expr(f"sequence(0, n - 1, {size})")).alias("chunk_no", "at"))
    part = F.substring(F.col("b"), F.col("at") + 1, F.lit(size))
    return b.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.octet_length(part).cast("long").alias("chunk_len"), F.sha2(part, 256).alias("chunk_sha256"))


def recent(rows: DataFrame, order: list, reverse: list, n: int = RECENT_DEFAULT) -> DataFrame:
    """The last n rows (clamped to 1 and the most allowed), in rising order. A top-k, so that no global sort is needed."""
    return rows.orderBy(*reverse).limit(max(1, min(RECENT_MOST, n))).orderBy(*order)


def lookup(rows: DataFrame, tombstones: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """requests with status Found, Deleted (a tombstone) or NotFound."""
    there = rows.select(*keys).distinct().withColumn("there", F.lit(True))
    gone = tombstones.select(*keys).distinct().withColumn("gone", F.lit(True))
    return requests.join(there, keys, "left").join(gone, keys, "left").withColumn("status", F.when(F.col("gone"), "Deleted").when(F.col("there"), "Found").otherwise("NotFound")).drop("there", "gone")


def verify(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: checked, failures: states whose length or digest isn't the expected one, or that one side lacks."""
    f = found.select(*keys, F.octet_length("state").cast("long").alias("l1"), F.sha2("state", 256).alias("h1"))
    e = expected.select(*keys, F.col("state_len").alias("l2"), F.col("state_sha256").alias("h2"))
    bad = ~(F.col("l1").eqNullSafe(F.col("l2")) & F.col("h1").eqNullSafe(F.col("h2")))
    return f.join(e, keys, "full").agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("failures"))


def against(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected (keys, want), how many of them actual (keys, got) lacks, and how many it has otherwise."""
    j = expected.join(actual.withColumn("there", F.lit(True)), keys, "left")
    return j.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & ~F.col("got").eqNullSafe(F.col("want"))).alias("different"))
