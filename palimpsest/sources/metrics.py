"""Prometheus text of counters and gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gauges of geometry() by column, with their help.
GAUGES = [
    ("checkpoint_count", "palimpsest_checkpoints", "Current committed checkpoints."), ("thread_count", "palimpsest_threads", "Current threads."),
    ("root_count", "palimpsest_roots", "Checkpoints without a parent."), ("leaf_count", "palimpsest_leaves", "Checkpoints without a child."),
    ("branch_point_count", "palimpsest_branch_points", "Checkpoints with several children."), ("maximum_fanout", "palimpsest_maximum_fanout", "Most children of a checkpoint."),
    ("maximum_depth", "palimpsest_maximum_depth", "Longest way to a root."), ("logical_state_bytes", "palimpsest_logical_state_bytes", "Bytes of all states."),
]


#: Gauges of a store's files and service, and its counters, with their help.
STORE_GAUGES = {
    "versions": "Channels of all checkpoints.", "sealed_checkpoints": "Checkpoints of the sealed generation.", "hot_logical_bytes": "Bytes of messages since the last seal.",
    "file_length_bytes": "Bytes of all files of the store.", "allocated_bytes": "Bytes that files of the store take.", "store_files": "Files of the store.",
    "service_uptime_seconds": "Seconds since the store was opened.", "last_append_write_nanoseconds": "Time that the last append's table took to write.",
    "last_append_sync_data_nanoseconds": "Time that the last append's commit took.",
}
COUNTERS = {
    "http_requests": "Requests answered.", "http_errors": "Requests answered by an error.", "durable_appends": "Checkpoints appended.", "read_requests": "Checkpoints read.",
    "import_requests": "Imports.", "imported_checkpoints": "Checkpoints imported.", "accepted_message_values": "Messages appended.", "accepted_message_json_bytes": "Bytes of messages appended.",
}


def plain(values: dict[str, int], counters: dict[str, int]) -> str:
    """The exposition text of a store's own gauges and counters."""
    line = lambda name, kind, text, value: f"# HELP {name} {text}\n# TYPE {name} {kind}\n{name} {value}\n"
    return "".join(line(f"palimpsest_{n}", "gauge", h, values.get(n, 0)) for n, h in STORE_GAUGES.items()) + "".join(line(f"palimpsest_{n}_total", "counter", h, counters[n]) for n, h in COUNTERS.items())


def gauges(one_row: DataFrame) -> DataFrame:
    """(name, kind, help, value) of a row of geometry()."""
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit("gauge").alias("kind"), F.lit(h).alias("help"), F.col(c).cast("long").alias("value")) for c, n, h in GAUGES])).alias("m")).select("m.*")


def text(metrics: DataFrame) -> DataFrame:
    """metrics with their exposition text."""
    return metrics.withColumn("text", F.format_string("# HELP %s %s\n# TYPE %s %s\n%s %d\n", "name", "help", "name", "kind", "name", "value"))
