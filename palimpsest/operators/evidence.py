"""Comparisons of stores: how large layouts are, what runs report, whether they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..model import APPEND_STATUS, READ_STATUS


def layouts(rows: DataFrame, keys: list[str], order: str, message: str = "message") -> DataFrame:
    """By thread: bytes of all full snapshots, of deltas, and of distinct messages (content-addressed) with their ratios."""
    from . import checkpoints

    lengths = checkpoints.state_lengths(rows, keys, order, message).withColumn("size", F.octet_length(message).cast("long"))
    whole = lengths.groupBy(*keys).agg(F.sum("state_len").alias("snapshot_bytes"), F.sum("size").alias("delta_bytes"))
    blobs = rows.groupBy(*keys, F.sha2(message, 256).alias("digest")).agg(F.first(F.octet_length(message)).cast("long").alias("size")).groupBy(*keys).agg(F.sum("size").alias("cas_bytes"))
    return whole.join(blobs, keys).withColumn("snapshot_over_delta", stats.ratio(F.col("snapshot_bytes"), F.col("delta_bytes"))).withColumn("snapshot_over_cas", stats.ratio(F.col("snapshot_bytes"), F.col("cas_bytes")))


def scalar_at(document: Column, *path: str) -> Column:
    """A scalar inside a JSON document, null wherever the path ends early."""
    return F.get_json_object(document, "$." + ".".join(path))


def run_figures(document: Column) -> Column:
    """A run's report cut to its figures; marginal bytes need both totals, and the read time falls back to the packed one."""
    number = lambda *p: scalar_at(document, *p).try_cast("long")
    return F.struct(
        scalar_at(document, "result", "backend").alias("backend"), scalar_at(document, "result", "pass").cast("boolean").alias("pass"), number("peak_rss_bytes").alias("peak_rss_bytes"),
        (number("result", "storage", "reopened", "allocated_bytes") - number("result", "storage", "empty", "allocated_bytes")).alias("marginal_bytes"),
        number("result", "latency", "durable_append", "p50_ns").alias("append_p50_ns"),
        F.coalesce(F.nullif(number("result", "exactness", "reopened", "read_latency", "p50_ns"), F.lit(0).cast("long")), number("result", "exactness", "reopened_after_aggressive_pack", "read_latency", "p50_ns")).alias("read_p50_ns"))


def recovered(checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logical_id, config) of checkpoints (metadata: JSON, config) that a loop wrote under an id, and ids found twice, which
    single_configs() refuses."""
    rows = checkpoints.select(F.get_json_object("metadata", "$.source").alias("source"), F.get_json_object("metadata", "$.canonical_checkpoint_id").alias("logical_id"), "config").filter("source = 'loop' and logical_id is not null").drop("source")
    twice = rows.groupBy("logical_id").count().filter("count > 1").select("logical_id")
    return rows, twice


def single_configs(checkpoints: DataFrame) -> DataFrame:
    """recovered(), where every id is found once; raises if one isn't."""
    rows, twice = recovered(checkpoints)
    if found := twice.first():
        raise ValueError(f"{found['logical_id']} was recovered twice")
    return rows


def reduced(batches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A list channel: batches (arrays) appended in order, flattened by one level."""
    return batches.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "batch"))), lambda x: x["batch"])).alias("value"))


def parsed_marks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(mark, object_id) of lines `:mark object`; others are left out."""
    return lines.select(F.regexp_extract(column, r"^:(\d+) ([0-9a-f]+)$", 1).alias("mark"), F.regexp_extract(column, r"^:(\d+) ([0-9a-f]+)$", 2).alias("object_id")).filter("mark <> ''").withColumn("mark", F.col("mark").cast("long"))


def http_status(kind: Column, appending: bool = False) -> Column:
    """The status an API answers an error kind with."""
    out = F
    for name, status in (APPEND_STATUS if appending else READ_STATUS).items():
        out = out.when(kind == name, F.lit(status))
    return out.otherwise(F.lit(500))


def repeated_bindings(bindings: DataFrame) -> DataFrame:
    """(history_id, binding, n) of version bindings that a history uses more than once."""
    return bindings.filter("binding is not null").groupBy("history_id", "binding").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def agreement(results: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: whether all arms (exact, checkpoints, attempts) are exact and count alike."""
    return results.groupBy(*keys).agg(F.bool_and("exact").alias("all_exact"), (F.countDistinct("checkpoints", "attempts") == 1).alias("counts_equal"))
