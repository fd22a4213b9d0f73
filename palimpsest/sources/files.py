"""Corpus files: manifests, required columns, frozen corpora, partition sinks and storage accounting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of one frozen instance per line.
FROZEN = (
    "format_version int, source string, resolved_revision string, instance_id string,"
    " attempts array<struct<attempt_id: string, solved: boolean, source_row_fingerprint: string, checkpoint_path: array<string>>>,"
    " nodes array<struct<checkpoint_id: string, parent_checkpoint_id: string, sequence_no: bigint, operations: array<struct<op: string, value: string>>,"
    " logical_state_len: bigint, logical_state_sha256: string, observations: bigint>>,"
    " stats struct<attempt_count: bigint, solved_attempt_count: bigint, observed_checkpoint_count: bigint, unique_checkpoint_node_count: bigint,"
    " shared_checkpoint_observations: bigint, observed_cumulative_full_state_bytes: bigint, unique_node_cumulative_full_state_bytes: bigint>"
)


def manifest_paths(spark: SparkSession, folder: str, manifest: str = "source_manifest.json") -> list[str]:
    """Paths of the Parquet files that a manifest lists ({"files": [{"path": ...}]}); raises if one isn't there."""
    text = spark.read.text(f"{folder}/{manifest}", wholetext=True).first()[0]
    out = [f"{folder}/{f['path']}" for f in json.loads(text)["files"] if f["path"].endswith(".parquet")]
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    if missing := [p for p in out if not path(p).getFileSystem(conf).exists(path(p))]:
        raise FileNotFoundError(", ".join(missing))
    return out


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def storage(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files and bytes under a folder, from listings alone (allocated blocks are the file system's own matter)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df cut to the columns; raises before any scan if one is missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def scan(spark: SparkSession, folder: str, columns: list[str], manifest: str | None = None) -> DataFrame:
    paths = manifest_paths(spark, folder, manifest) if manifest else [folder]
    return require(spark.read.parquet(*paths), columns)


def frozen(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, attempts and paths (one row a step) of a frozen corpus; malformed lines fail."""
    rows = spark.read.text(path).select(F.from_json("value", FROZEN, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    nodes = rows.select("instance_id", F.explode("nodes").alias("n")).select("instance_id", "n.*")
    attempts = rows.select("instance_id", F.explode("attempts").alias("a")).select("instance_id", "a.*")
    steps = attempts.select("instance_id", "attempt_id", F.posexplode("checkpoint_path").alias("i", "checkpoint_id"))
    return {"nodes": nodes, "attempts": attempts, "paths": steps, "stats": rows.select("instance_id", "stats.*")}


def topology_faults(nodes: DataFrame) -> DataFrame:
    """(instance_id, checkpoint_id, fault): repeated ids and parents that aren't there."""
    twice = nodes.groupBy("instance_id", "checkpoint_id").count().filter("count > 1").select("instance_id", "checkpoint_id", F.lit("Duplicate").alias("fault"))
    known = nodes.select("instance_id", F.col("checkpoint_id").alias("parent_checkpoint_id")).distinct()
    orphan = nodes.filter("parent_checkpoint_id is not null").join(known, ["instance_id", "parent_checkpoint_id"], "left_anti").select("instance_id", "checkpoint_id", F.lit("MissingParent").alias("fault"))
    return twice.unionByName(orphan)


def write_attempt_refs(attempts: DataFrame, path: str) -> None:
    """One JSON line an attempt (attempt_id, instance_id, solved, source_row_fingerprint, tip_checkpoint_id), sorted by
    instance and attempt within ranges of these."""
    ranged = attempts.repartitionByRange("instance_id", "attempt_id").sortWithinPartitions("instance_id", "attempt_id")
    ranged.select(attempt_ref(attempts).alias("value")).write.text(path)


def attempt_ref(attempts: DataFrame) -> Column:
    return F.to_json(F.struct(*[attempts[c] for c in ("attempt_id", "instance_id", "solved", "source_row_fingerprint", "tip_checkpoint_id")]), {"ignoreNullFields": "false"})


def partition_manifest(lines: DataFrame, partition: str) -> DataFrame:
    """By partition: lines, bytes and the SHA-256 over its lines' own digests, in order of key: what a reader can check
    without the text. lines: (key, line, the partition's column)."""
    each = lines.select(partition, "key", F.sha2("line", 256).alias("d"), F.octet_length("line").cast("long").alias("b"))
    # 4096 ranges of digests by key keep any one array short
    part = each.withColumn("r", F.pmod(F.xxhash64("key"), F.lit(4096)))
    some = part.groupBy(partition, "r").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return some.groupBy(partition).agg(F.sum("n").alias("lines"), F.sum("b").alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def write_partition(lines: DataFrame, key: str, path: str, partition: str | None = None) -> None:
    """Lines of JSON, sorted by key within ranges of it; partitioned by a column where one is named."""
    ranged = lines.repartitionByRange(key).sortWithinPartitions(key)
    if partition:
        ranged.select(partition, F.col("line").alias("value")).write.partitionBy(partition).text(path)
    else:
        ranged.select(F.col("line").alias("value")).write.text(path)


def fork_workload(spark: SparkSession, threads: int = 4, branches: int = 100, base: int = 64 << 10, delta: int = 4 << 10) -> DataFrame:
    """(thread, node, parent, message): per thread a root of base bytes and branches of delta bytes, the same each time."""
    rows = spark.range(threads * (branches + 1)).select(F.expr(f"id div {branches + 1}").alias("thread"), F.expr(f"id % {branches + 1}").alias("node"))
    text = lambda n: F.substring(F.repeat(F.sha2(F.concat_ws("/", "thread", "node"), 256), n // 64 + 1), 1, n)
    return rows.withColumn("parent", F.when(F.col("node") > 0, F.lit(0).cast("long"))).withColumn("message", F.when(F.col("node") == 0, text(base)).otherwise(text(delta)))
