"""Forests of checkpoints: whatever folds along the way to the root, geometry, pruning.

Folds go by pointer doubling: in round r each node knows its ancestor 2^r steps up and the fold of all between, so a
depth of d takes log2(d) joins on (thread, node), at any shape, with no recursion limit. Rounds are written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import dropped, written


def fold_to_root(nodes: DataFrame, value: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(thread, node, value folded from the root to the node), of nodes (thread, node, parent: null at a root).

    combine(earlier, later) is associative. A parent that isn't there ends the way, as a root does; cycles end after as
    many rounds as the largest thread could need."""
    now = written(nodes.select("thread", "node", F.col("parent").alias("up"), value.alias("value")))
    most = now.groupBy("thread").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, (most - 1).bit_length())):
        above = now.select("thread", F.col("node").alias("up"), F.col("up").alias("further"), F.col("value").alias("earlier"), F.lit(True).alias("there"))
        moved = now.join(above, ["thread", "up"], "left").select(
            "thread", "node", F.col("further").alias("up"), F.when(F.col("there"), combine(F.col("earlier"), F.col("value"))).otherwise(F.col("value")).alias("value"))
        following = written(moved)
        dropped(now)
        now = following
        if now.filter("up is not null").isEmpty():
            break
    return now.select("thread", "node", "value")


def depths(nodes: DataFrame) -> DataFrame:
    """(thread, node, depth); a root has depth 1."""
    return fold_to_root(nodes, F.lit(1).cast("long"), lambda a, b: a + b).withColumnRenamed("value", "depth")


def geometry(nodes: DataFrame, length: str) -> DataFrame:
    """One row of counts; length names the bytes a node appends. State length: 15 + all bytes + commas.

    nodes are written first: whatever makes them would otherwise run again, and hold its memory, in the tasks that count."""
    nodes = written(nodes.select("thread", "node", "parent", length))
    both = lambda a, b: F.struct((a["d"] + b["d"]).alias("d"), (a["l"] + b["l"]).alias("l"))
    deep = fold_to_root(nodes, F.struct(F.lit(1).cast("long").alias("d"), F.col(length).cast("long").alias("l")), both)
    way = deep.agg(F.max("value.d").alias("maximum_depth"), F.sum(15 + F.col("value.l") + F.col("value.d") - 1).alias("logical_state_bytes"))
    fan = fanout(nodes).agg(F.count(F.lit(1)).alias("parents"), F.count_if(F.col("children") > 1).alias("branch_point_count"), F.max("children").alias("maximum_fanout"))
    base = nodes.agg(F.countDistinct("thread").alias("thread_count"), F.count_if(F.col("parent").isNull()).alias("root_count"), F.count(F.lit(1)).alias("checkpoint_count"))
    return base.crossJoin(fan).crossJoin(way).select(  # single rows each
        "thread_count", "checkpoint_count", "root_count", (F.col("checkpoint_count") - F.col("parents")).alias("leaf_count"), "branch_point_count",
        F.coalesce("maximum_fanout", F.lit(0)).alias("maximum_fanout"), "maximum_depth", "logical_state_bytes")


def fanout(nodes: DataFrame) -> DataFrame:
    """(thread, parent, children) of nodes that have children."""
    return nodes.filter("parent is not null").groupBy("thread", "parent").agg(F.count(F.lit(1)).alias("children"))


def fork_appends(nodes: DataFrame, seq: str) -> DataFrame:
    """Appends whose parent had a child already."""
    rank = F.row_number().over(W.partitionBy("thread", "parent").orderBy(seq))
    return nodes.filter("parent is not null").withColumn("nth", rank).filter("nth > 1").withColumn("nth", F.col("nth").cast("long"))


def subtree(nodes: DataFrame, target: Column) -> DataFrame:
    """(thread, node) of the targets and all below them."""
    return fold_to_root(nodes, target, lambda a, b: a | b).filter("value").select("thread", "node")


def prune(nodes: DataFrame, target: Column, seq: str) -> tuple[DataFrame, DataFrame]:
    """Survivors with a dense new ordinal in each thread, and tombstones of the pruned."""
    gone = written(subtree(nodes, target))
    left = nodes.join(gone, ["thread", "node"], "left_anti")
    return left.withColumn("ordinal", (F.row_number().over(W.partitionBy("thread").orderBy(seq)) - 1).cast("long")), gone


def overlaid(base: DataFrame, hot: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live rows (thread, node, ...): a sealed base, rows of a hot suffix in place of those of the same key, less tombstones."""
    key = ["thread", "node"]
    return base.join(hot.select(*key), key, "left_anti").unionByName(hot).join(tombstones.select(*key), key, "left_anti")


def nearest_marked(nodes: DataFrame, marked: Column) -> DataFrame:
    """(thread, node, value): each node's nearest marked ancestor, itself included, or null."""
    return fold_to_root(nodes, F.when(marked, F.col("node")), lambda a, b: F.coalesce(b, a))


def concatenated(nodes: DataFrame, text: str, separator: str) -> DataFrame:
    """(thread, node, value): texts from the root to each node."""
    return fold_to_root(nodes, F.col(text), lambda a, b: F.concat(a, F.lit(separator), b))
