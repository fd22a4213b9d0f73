"""Compactions of version catalogues and checkpoints, and images of chosen roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written


def keep_ancestry(versions: DataFrame, live: DataFrame) -> DataFrame:
    """versions (thread, node, parent) that are live (thread, node) or above a live one: parents stay as they are.

    Round r adds to the kept what stands 2^r steps above them, so that a depth of d takes log2(d) rounds, and no round's
    table holds more rows than there are versions."""
    jump = written(versions.select("thread", "node", F.col("parent").alias("up")).filter("up is not null"))
    kept = written(live.select("thread", "node").distinct())
    for _ in range(64):  # rounds that any number of versions could need; cycles end here too
        if jump.isEmpty():
            break
        above = kept.join(jump, ["thread", "node"]).select("thread", F.col("up").alias("node"))
        more = written(kept.unionByName(above).distinct())
        further = jump.select("thread", F.col("node").alias("up"), F.col("up").alias("further"))
        longer = written(jump.join(further, ["thread", "up"]).select("thread", "node", F.col("further").alias("up")))
        dropped(kept)
        dropped(jump)
        kept, jump = more, longer
    return versions.join(kept, ["thread", "node"], "left_semi")


def keep_referenced(versions: DataFrame, live: DataFrame) -> DataFrame:
    """versions that are live themselves; parents that aren't kept become null."""
    kept = versions.join(live.select("thread", "node"), ["thread", "node"], "left_semi")
    there = kept.select("thread", F.col("node").alias("parent"), F.lit(True).alias("there"))
    return kept.join(there, ["thread", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")


def export_image(versions: DataFrame, leaves: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen versions (history_id, seq), and the leaves that they show."""
    chosen = versions.join(roots.select("history_id", "seq"), ["history_id", "seq"], "left_semi")
    used = chosen.select("history_id", F.explode("pieces.leaf").alias("leaf")).distinct()
    return chosen, leaves.join(used, ["history_id", "leaf"], "left_semi")


def image_faults(versions: DataFrame, leaves: DataFrame) -> DataFrame:
    """(history_id, seq, fault) of versions whose pieces lack a leaf, leave its bounds, or don't add up to len."""
    p = versions.select("history_id", "seq", "len", F.explode_outer("pieces").alias("p"))
    j = p.withColumn("leaf", F.col("p.leaf")).join(leaves.select("history_id", "leaf", F.octet_length("payload").alias("size"), F.lit(True).alias("there")), ["history_id", "leaf"], "left")
    per = j.groupBy("history_id", "seq").agg(
        F.bool_or(F.col("p").isNotNull() & F.col("there").isNull()).alias("lost"), F.bool_or((F.col("p.off") < 0) | (F.col("p.len") <= 0) | (F.col("p.off") + F.col("p.len") > F.col("size"))).alias("out"),
        (F.coalesce(F.sum("p.len"), F.lit(0)) != F.max("len")).alias("length"))
    fault = F.when(F.col("lost"), "MissingLeaf").when(F.col("out"), "PieceBounds").when(F.col("length"), "Length")
    return per.withColumn("fault", fault).filter("fault is not null").select("history_id", "seq", "fault")


def covering_segment(points: DataFrame, segments: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """points with the segment (st, len) of their key that covers at: an equi-join with the interval as a residual."""
    s = segments.select(*keys, F.col("st").alias("seg_st"), F.col("len").alias("seg_len"))
    return points.join(s, keys).filter((at >= F.col("seg_st")) & (at < F.col("seg_st") + F.col("seg_len")))
