"""Checkpoints as JSON lines: strict import, export, and import of exported full states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon
from ..model import EXPORT_FORMAT, EXPORT_VERSION
from ..scratch import written

# The fields of a line, and below the texts that an importer answers a bad line with.
FIELDS = ["thread_id", "checkpoint_id", "checkpoint_no", "parent_checkpoint_id", "messages"]
#: Types as get_json_object() can't tell them apart: read as variants.
U32 = (1 << 32) - 1


def json_elements(array: Column) -> Column:
    """The elements of a JSON array as JSON texts; null if it is none. Numbers keep their digits, strings are quoted again."""
    kinds = F.transform(F.try_variant_get(F.try_parse_json(array), "$", "array<variant>"), lambda m: F.coalesce(F.schema_of_variant(m), F.lit("VOID")))
    quote = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", "")
    return F.zip_with(F.from_json(array, "array<string>"), kinds, lambda x, k: F.when(k == "STRING", quote(x)).otherwise(F.coalesce(x, F.lit("null"))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a file's lines that aren't blank, numbered from 1 with the blank ones.

    Splits are read in parallel: lines are numbered within each block of the file and shifted by the counts of the blocks
    before, one number a block."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    rows = written(rows)
    before, shifts = 0, []
    for r in sorted(rows.groupBy("f", "at").count().collect()):
        shifts.append((r["f"], r["at"], before))
        before += r["count"]
    if not shifts:
        return rows.select(F.col("i").alias("line_no"), "line")
    shift = F.broadcast(spark.createDataFrame(shifts, "f string, at long, before long"))
    n = F.row_number().over(W.partitionBy("f", "at").orderBy("i"))
    return rows.withColumn("n", n).join(shift, ["f", "at"]).select((F.col("n") + F.col("before")).alias("line_no"), "line").filter("trim(line) <> ''")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with the fields of a checkpoint and error: why a line isn't one, or null."""
    v = F.try_parse_json("line")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))
    out = lines.withColumn("v", v).withColumn("keys", F.json_object_keys("line"))
    unknown = F.array_sort(F.array_except("keys", F.array(*map(F.lit, FIELDS))))
    number = F.try_variant_get("v", "$.checkpoint_no", "long")
    messages = json_elements(F.get_json_object("line", "$.messages"))
    error = (
        F.when(F.col("v").isNull(), "invalid JSON").when(F.col("keys").isNull(), "checkpoint body must be a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.element_at(unknown, 1)))
        .when(F.coalesce(text("thread_id"), F.lit("")) == "", "thread_id must be a non-empty string")
        .when(F.coalesce(text("checkpoint_id"), F.lit("")) == "", "checkpoint_id must be a non-empty string")
        .when(~F.coalesce(kind("checkpoint_no") == "BIGINT", F.lit(False)) | F.coalesce(number < 0, F.lit(True)), "checkpoint_no must be an unsigned integer")
        .when(number > U32, "checkpoint_no exceeds u32")
        .when(F.array_contains("keys", "parent_checkpoint_id") & ~F.coalesce(kind("parent_checkpoint_id").isin("STRING", "VOID"), F.lit(True)), "parent_checkpoint_id must be a string or null")
        .when(messages.isNull(), "messages must be a JSON array").when(F.size(messages) == 0, "messages must contain at least one newly appended value")
    )
    return out.select(
        "line_no", "line", text("thread_id").alias("thread_id"), text("checkpoint_id").alias("checkpoint_id"), number.alias("checkpoint_no"), text("parent_checkpoint_id").alias("parent_checkpoint_id"),
        messages.alias("messages"), error.alias("error"))


def admitted(rows: DataFrame) -> DataFrame:
    """rows with error also for what the store refuses: repeated ids in a thread, and parents that don't come before.

    The import stops at its first error and keeps what stands before it; both checks look at earlier lines only, so they
    are the same before that line whatever follows it."""
    w = W.partitionBy("thread_id", "checkpoint_id").orderBy("line_no")
    first = rows.filter("error is null").groupBy("thread_id", "checkpoint_id").agg(F.min("line_no").alias("first_line"))
    parent = first.select("thread_id", F.col("checkpoint_id").alias("parent_checkpoint_id"), F.col("first_line").alias("parent_line"))
    out = rows.withColumn("nth", F.row_number().over(w)).join(parent, ["thread_id", "parent_checkpoint_id"], "left")
    late = F.when(F.col("nth") > 1, "duplicate checkpoint").when(F.col("parent_checkpoint_id").isNotNull() & ~F.coalesce(F.col("parent_line") < F.col("line_no"), F.lit(False)), "parent checkpoint not found")
    return out.withColumn("error", F.coalesce("error", late)).select("line_no", *FIELDS, "error")


def import_jsonl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The durable prefix (line_no, CHECKPOINT), and a report of one row: checkpoint_count, message_value_count,
    stopped_at (null if all went in), error."""
    rows = admitted(parsed(lines))
    cut = rows.filter("error is not null").agg(F.min("line_no").alias("stopped_at"), F.min_by("error", "line_no").alias("error"))
    kept = rows.join(F.broadcast(cut.select("stopped_at")), F.col("stopped_at").isNull() | (F.col("line_no") < F.col("stopped_at"))).select("line_no", *FIELDS)  # one row
    counted = kept.agg(F.count(F.lit(1)).alias("checkpoint_count"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("message_value_count"))
    return kept, counted.join(cut)


def export_rows(checkpoints: DataFrame) -> DataFrame:
    """Canonical export lines of checkpoints (thread_id, checkpoint_id, checkpoint_no, parent_checkpoint_id, all messages; identity
    and result, where there are such columns)."""
    fields = F.struct(
        F.col("checkpoint_id"), F.col("checkpoint_no"), F.col("parent_checkpoint_id"), F.col("thread_id"))
    head = F.to_json(fields, {"ignoreNullFields": "false"})
    state = canon.framed(F.array_join("messages", ","), F.col("identity"), F.col("result")) if "identity" in checkpoints.columns else canon.state(F.col("messages"))
    return checkpoints.withColumn("line", F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"state":'), state, F.lit("}")))


def envelope(lines: DataFrame, order: str) -> DataFrame:
    """One JSON document of all export lines in order: small stores only, as its one row holds them all."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), ",")
    return lines.agg(F.concat(F.lit(f'{{"format":"{EXPORT_FORMAT}","format_version":{EXPORT_VERSION},"checkpoint_count":'), F.count(F.lit(1)).cast("string"), F.lit(',"checkpoints":['), body, F.lit("]}")).alias("document"))


def import_states(full: DataFrame) -> DataFrame:
    """Deltas of full states: (thread_id, checkpoint_id, parent_checkpoint_id, messages: all) with delta and error, where
    the parent is missing, isn't a prefix, or nothing is new; a checkpoint of an identity (where there is such a column) has no
    messages, and its delta is empty."""
    p = full.select("thread_id", F.col("checkpoint_id").alias("parent_checkpoint_id"), F.col("messages").alias("before_"))
    j = full.join(p, ["thread_id", "parent_checkpoint_id"], "left").withColumn("n_", F.coalesce(F.size("before_"), F.lit(0)))
    prefix = F.slice(F.col("messages"), F.lit(1), F.col("n_")) == F.coalesce(F.col("before_"), F.array().cast("array<string>"))
    only = F.col("identity").isNotNull() if "identity" in full.columns else F.lit(False)
    error = F.when(F.col("parent_checkpoint_id").isNotNull() & F.col("before_").isNull(), "parent checkpoint not found").when(~prefix, "parent is not a prefix").when(~only & (F.size("messages") <= F.col("n_")), "empty delta")
    return j.withColumn("error", error).withColumn("delta", F.when(error.isNull(), F.slice(F.col("messages"), F.col("n_") + 1, F.size("messages")))).drop("before_", "n_")


def is_canonical(message: Column) -> Column:
    return F.try_parse_json(message).isNotNull()
