"""Corpus analytics: instances are tasks, attempts their trajectories, messages their steps.

An attempt's messages stay one array, so that prefixes are folded within the row: node identities are a chain of
digests (each over the one before and the message), which makes shared prefixes equal nodes with no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon, stats
from ..model import HANDS_MESSAGE, SWE_MESSAGE
from ..scratch import written

#: Which keys a message of each role keeps, and the fan-outs that are reported.
HANDS_KEYS = {"assistant": ["content", "role", "tool_calls"], "tool": ["content", "name", "role", "tool_call_id"]}
HANDS_DEFAULT = ["content", "role"]
FANOUTS = [2, 4, 8, 16, 32, 64]


def normalize_swe(trajectory: Column) -> Column:
    """Canonical messages of a JSON trajectory: the system prompt replaces a system message's text; null becomes ''."""
    def one(m: Column) -> Column:
        prompt = (m["role"] == "system") & (F.coalesce(m["system_prompt"], F.lit("")) != "")
        return canon.message(m["role"], F.coalesce(F.when(prompt, m["system_prompt"]).otherwise(m["text"]), F.lit("")))

    return F.transform(F.from_json(trajectory, SWE_MESSAGE), one)


def normalize_hands(trajectory: Column) -> Column:
    """Canonical messages with the keys of their role, missing ones as null."""
    def pick(m: Column, keys: list[str]) -> Column:
        return F.to_json(F.struct(*[m[k].alias(k) for k in keys]), {"ignoreNullFields": "false"})

    def one(m: Column) -> Column:
        out = F
        for role, keys in HANDS_KEYS.items():
            out = out.when(m["role"] == role, pick(m, keys))
        return out.otherwise(pick(m, HANDS_DEFAULT))

    return F.transform(F.from_json(trajectory, HANDS_MESSAGE), one)


def attempt_ids(rows: DataFrame, natural: str, revision: str, path: str, ordinal: str) -> DataFrame:
    """rows with attempt_id: the natural id, else a digest of where the row stands; repeats are digested again."""
    made = F.coalesce(F.expr(f"nullif({natural}, '')"), F.sha2(F.concat_ws("\0", F.lit(revision), F.col(path), F.col(ordinal).cast("string")), 256))
    w = W.partitionBy("instance_id", "first_id").orderBy(ordinal)
    out = rows.withColumn("first_id", made).withColumn("again", F.row_number().over(w) > 1)
    return out.withColumn("attempt_id", F.when(F.col("again"), F.sha2(F.concat_ws("\0", "first_id", F.col(ordinal).cast("string")), 256)).otherwise(F.col("first_id"))).drop("first_id", "again")


def accounted(attempts: DataFrame) -> DataFrame:
    """attempts (messages: array of canonical JSON) with checkpoints, message_bytes, final_bytes, cumulative_bytes."""
    lens = F.transform("messages", lambda m: F.octet_length(m).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("i"))

    def step(a: Column, n: Column) -> Column:
        p = a["p"] + n + F.when(a["i"] > 0, 1).otherwise(0)
        return F.struct(p.alias("p"), (a["c"] + p + canon.EMPTY_STATE_LEN).alias("c"), (a["i"] + 1).alias("i"))

    out = attempts.withColumn("acc_", F.aggregate(lens, zero, step))
    return out.withColumn("checkpoints", F.size("messages").cast("long")).withColumn("message_bytes", F.aggregate(lens, F.lit(0).cast("long"), lambda a, n: a + n)).withColumn("final_bytes", canon.EMPTY_STATE_LEN + F.col("acc_.p")).withColumn("cumulative_bytes", F.col("acc_.c")).drop("acc_")


def profile(attempts: DataFrame) -> DataFrame:
    """By instance: attempts, solved_attempts, checkpoints, final_bytes, cumulative_bytes."""
    return accounted(attempts).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.coalesce(F.col("solved"), F.lit(False))).alias("solved_attempts"), F.sum("checkpoints").alias("checkpoints"),
        F.sum("final_bytes").alias("final_bytes"), F.sum("cumulative_bytes").alias("cumulative_bytes"))


def observations(attempts: DataFrame) -> DataFrame:
    """(instance_id, attempt_id, depth, node, parent, message, state_len): one row per step of each attempt."""
    def step(a: Column, m: Column) -> Column:
        node = F.sha2(F.concat_ws(",", a["node"], F.sha2(m, 256)), 256)
        size = a["size"] + F.octet_length(m) + F.when(F.size(a["out"]) > 0, 1).otherwise(0)
        return F.struct(node.alias("node"), size.cast("int").alias("size"), F.array_append(a["out"], F.struct(node.alias("node"), size.cast("int").alias("state_len"))).alias("out"))

    start = F.expr("named_struct('node', '', 'size', 15, 'out', cast(array() as array<struct<node:string,state_len:int>>))")
    chain = F.aggregate("messages", start, step, lambda a: a["out"])
    rows = attempts.withColumn("chain", chain).select("instance_id", "attempt_id", "chain", F.posexplode(F.arrays_zip(F.col("messages").alias("m"), F.col("chain").alias("c"))).alias("i", "x"))
    return rows.select("instance_id", "attempt_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("x.c.node").alias("node"), F.expr("get(chain, i - 1).node").alias("parent"), F.col("x.m").alias("message"), F.col("x.c.state_len").cast("long").alias("state_len"))


def trie(seen: DataFrame) -> DataFrame:
    """Unique nodes of observations(): (instance_id, node, parent, depth, message, state_len, observations)."""
    return seen.groupBy("instance_id", "node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("message").alias("message"), F.first("state_len").alias("state_len"), F.count(F.lit(1)).alias("observations"))


def trie_stats(nodes: DataFrame) -> DataFrame:
    """By instance: observed and unique nodes, shared observations, observed and unique state bytes."""
    return nodes.groupBy("instance_id").agg(
        F.sum("observations").alias("observed_nodes"), F.count(F.lit(1)).alias("unique_nodes"), (F.sum("observations") - F.count(F.lit(1))).alias("shared_observations"),
        F.sum(F.col("observations") * F.col("state_len")).alias("observed_bytes"), F.sum("state_len").alias("unique_bytes"))


def common_prefix(attempts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(instance_id, common_prefix): depth to which all attempts of an instance agree."""
    n = attempts.groupBy("instance_id").agg(F.count(F.lit(1)).alias("attempts"))
    deepest = nodes.groupBy("instance_id", "observations").agg(F.max("depth").alias("depth"))  # few rows an instance
    return n.join(deepest, "instance_id", "left").groupBy("instance_id").agg(F.coalesce(F.max(F.when(F.col("observations") == F.col("attempts"), F.col("depth"))), F.lit(0)).cast("long").alias("common_prefix"))


def fanout_thresholds(profiles: DataFrame) -> DataFrame:
    """(threshold, instances): how many instances have so many attempts or more."""
    return profiles.select("attempts", F.explode(F.array(*map(F.lit, FANOUTS))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("attempts") >= F.col("threshold")).alias("instances"))


def seeded(column: str, seed: str, revision: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(seed), F.lit(revision), F.col(column)), 256)


def top_instances(profiles: DataFrame, n: int = 25) -> DataFrame:
    """The instances with most attempts; ties by digest of the id."""
    return profiles.withColumn("id_sha256", F.sha2("instance_id", 256)).orderBy(F.desc("attempts"), "id_sha256").limit(n)


def fill_partitions(profiles: DataFrame, partitions: list[tuple[str, int, int]], seed: str, revision: str, least_attempts: int) -> DataFrame:
    """profiles in seeded order, dealt to (name, target bytes, least instances) in turn until both are reached.

    Each cut depends on the one before, but only through two running numbers. The seeded order is a digest, so its first
    digits deal the instances evenly into ranges: running bytes and counts are taken within ranges and shifted by the
    ranges' totals (4096 at most), and a single-row lookup finds each cut. Raises if the instances run out.
    """
    rows = profiles.filter(F.col("attempts") >= least_attempts).withColumn("rank_", seeded("instance_id", seed, revision)).withColumn("range_", F.substring("rank_", 1, 3))
    rows = written(rows)
    shifts, pos, before = [], 0, 0
    for r in sorted(rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n"), F.sum("cumulative_bytes").alias("b")).collect()):
        shifts.append((r["range_"], pos, before))
        pos, before = pos + r["n"], before + r["b"]
    w = W.partitionBy("range_").orderBy("rank_")
    rows = rows.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("upto", F.sum("cumulative_bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    shift = F.broadcast(profiles.sparkSession.createDataFrame(shifts, "range_ string, pos_ long, before_ long"))
    rows = written(rows.join(shift, "range_").withColumn("pos", F.col("pos") + F.col("pos_")).withColumn("upto", F.col("upto") + F.col("before_")).drop("range_", "pos_", "before_"))
    label, pos, before = F.lit(None).cast("string"), 0, 0
    for name, target, least in partitions:
        cut = rows.filter((F.col("pos") >= pos + least) & (F.col("upto") - before >= target) & (F.col("pos") > pos)).agg(F.min_by("upto", "pos").alias("upto"), F.min("pos").alias("pos")).first()
        if cut["pos"] is None:
            raise ValueError(f"instances run out while {name} is filled")
        label = F.when((F.col("pos") > pos) & (F.col("pos") <= cut["pos"]), F.lit(name)).otherwise(label)
        pos, before = cut["pos"], cut["upto"]
    return rows.withColumn("partition", label).filter("partition is not null").drop("rank_", "upto")


def joined_back(chains: DataFrame, blobs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """By keys: lines, text and logical_bytes of chains (keys, order, digest) whose contents are blobs (digest, blob).

    A digest that many lines share is looked up as one row of blobs; AQE splits its partition."""
    j = chains.join(blobs, "digest")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "blob"))), lambda x: x["blob"]), "\n")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), text.alias("text"), F.sum(F.octet_length("blob").cast("long")).alias("logical_bytes"))


def inserted_if_absent(held: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """held (key, order) with what batch brings: of each key that held lacks the first row, inserted; held rows stay."""
    fresh = batch.groupBy(key).agg(F.min(order).alias(order)).join(held.select(key), key, "left_anti")
    return held.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, p25 to p99 by the nearest index, max."""
    marks = {f"p{int(100 * f)}": (lambda n, f=f: stats.nearest(n, f)) for f in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
    return stats.at_ranks(df, keys, value, {"min": lambda n: F.lit(0)} | marks | {"max": lambda n: n - 1}).withColumnRenamed("n", "count")


def corpus_faults(nodes: DataFrame, seen: DataFrame, given: DataFrame) -> DataFrame:
    """(instance_id, fault, n) of nodes that don't hold: repeated ids, missing or later parents, wrong lengths, ids that aren't
    the digest of the parent's and the one message, steps of paths that aren't edges, counts that differ from the paths, and
    totals (given: instance_id, observed_nodes, unique_nodes, observed_bytes, unique_bytes) that differ."""
    fault = lambda df, name: df.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).select("instance_id", F.lit(name).alias("fault"), "n")
    twice = nodes.groupBy("instance_id", "node").count().filter("count > 1")
    parents = nodes.select("instance_id", F.col("node").alias("parent"), F.col("depth").alias("above"), F.col("state_len").alias("before"))
    linked = nodes.join(parents, ["instance_id", "parent"], "left")
    orphan = linked.filter("parent is not null and above is null or parent is null and depth <> 1")
    order = linked.filter("above is not null and above + 1 <> depth")
    size = linked.filter(F.col("state_len") != F.coalesce(F.col("before") + 1, F.lit(canon.EMPTY_STATE_LEN)) + F.octet_length("message"))
    digest = nodes.filter(F.col("node") != F.sha2(F.concat_ws(",", F.coalesce("parent", F.lit("")), F.sha2("message", 256)), 256))
    edges = seen.join(nodes.select("instance_id", "node", F.col("parent").alias("above"), F.col("depth").alias("at")), ["instance_id", "node"]).filter("not (parent <=> above and depth = at)")
    counted = seen.groupBy("instance_id", "node").agg(F.count(F.lit(1)).alias("c"))
    counts = nodes.join(counted, ["instance_id", "node"], "full").filter("not (observations <=> c)")
    totals = trie_stats(nodes).join(given.select("instance_id", *[F.col(c).alias(f"g_{c}") for c in ("observed_nodes", "unique_nodes", "observed_bytes", "unique_bytes")]), "instance_id", "full").filter(
        "not (observed_nodes <=> g_observed_nodes and unique_nodes <=> g_unique_nodes and observed_bytes <=> g_observed_bytes and unique_bytes <=> g_unique_bytes)")
    out = fault(twice, "DuplicateNode")
    for df, name in ((orphan, "MissingParent"), (order, "ParentOrder"), (size, "StateLength"), (digest, "NodeDigest"), (edges, "PathEdge"), (counts, "Observations"), (totals, "Totals")):
        out = out.unionByName(fault(df, name))
    return out
