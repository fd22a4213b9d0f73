"""The registered queries over the driver's tables, each beside its SQL.

Roles of the tables: conversations are append chains of messages (thread, turn); events per user are forests (row number
rn; parent rn - 1: chain, rn div 2: heap, 1: flat) and operation logs; documents by lang are instances, a document an
attempt, its lines messages, labels whether it was solved; lineitem and orders carry values for statistics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon, stats
from ..model import READ_STATUS
from ..operators import checkpoints, compaction, corpus, evidence, forest, history
from ..scratch import written
from ..sources import files, jsonl, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["thread_id"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Chains ---------------------------------------------------------------------------------------------------------------------


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("long").alias("thread_id"), F.col("turn").cast("long").alias("checkpoint_no"), "role", "text", canon.message(F.col("role"), F.col("text")).alias("message"))


CHAINS = """
WITH msg AS (SELECT conv_id AS thread_id, turn AS checkpoint_no, role, text, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS message FROM conversations),
st AS (SELECT *, '{"messages":[' || string_agg(message, ',') OVER (PARTITION BY thread_id ORDER BY checkpoint_no) || ']}' AS state FROM msg),
fin AS (SELECT thread_id, arg_max(state, checkpoint_no) AS state FROM st GROUP BY thread_id)
"""


@query(CHAINS + "SELECT thread_id, checkpoint_no, strlen(state) AS state_len, sha256(state) AS state_sha256 FROM st")
def flagship_state_sha(spark, sf_dir):
    """Every checkpoint's canonical state, by length and digest."""
    s = checkpoints.states(chains(spark, sf_dir), KEYS, "checkpoint_no")
    return s.select("thread_id", "checkpoint_no", F.octet_length("state").cast("long").alias("state_len"), F.sha2("state", 256).alias("state_sha256"))


@query(CHAINS + "SELECT thread_id, checkpoint_no, strlen(state) AS state_len FROM st")
def state_lengths(spark, sf_dir):
    return checkpoints.state_lengths(chains(spark, sf_dir), KEYS, "checkpoint_no").select("thread_id", "checkpoint_no", "state_len")


@query("""WITH msg AS (SELECT conv_id, turn, text, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS message FROM conversations),
st AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '{"identity":{"conv":' || conv_id || '},"messages":[]}'
    WHEN 1 THEN '{"identity":null,"messages":[' || string_agg(message, ',') OVER w || '],"result":' || strlen(text) || '}'
    ELSE '{"messages":[' || string_agg(message, ',') OVER w || ']}' END AS state FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS thread_id, turn AS checkpoint_no, strlen(state) AS state_len, sha256(state) AS state_sha256 FROM st""")
def channel_states(spark, sf_dir):
    """States of three channels: identities alone, messages alone, messages with a result."""
    rows, kind = chains(spark, sf_dir), F.col("thread_id") % 3
    body = F.array_join(F.collect_list(F.when(kind > 0, F.col("message"))).over(checkpoints.chain(KEYS, "checkpoint_no")), ",")
    identity = F.when(kind == 0, F.concat(F.lit('{"conv":'), "thread_id", F.lit("}")))
    s = rows.withColumn("state", canon.framed(body, identity, F.when(kind == 1, F.octet_length("text").cast("string"))))
    return s.select("thread_id", "checkpoint_no", F.octet_length("state").cast("long").alias("state_len"), F.sha2("state", 256).alias("state_sha256"))


@query("""SELECT a.lang AS instance_id, a.doc_id AS attempt_id, sha256('{"attempt_id":' || a.doc_id || ',"instance_id":"' || a.lang || '","solved":' || coalesce(s.solved, false) || ',"source_row_fingerprint":"' || sha256(a.text) || '","tip_checkpoint_id":"' || a.doc_id || '-' || len(string_split(a.text, chr(10))) || '"}') AS line_sha256
FROM documents a LEFT JOIN (SELECT doc_id, max(quality) = 1 AS solved FROM labels GROUP BY 1) s USING (doc_id)""")
def attempt_refs(spark, sf_dir):
    """The sidecar of attempts: each with its tip checkpoint."""
    a = attempts(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("attempt_id"), F.sha2("text", 256).alias("source_row_fingerprint")), "attempt_id")
    a = a.withColumn("tip_checkpoint_id", F.concat_ws("-", "attempt_id", F.size("messages")))
    return a.select("instance_id", "attempt_id", F.sha2(files.attempt_ref(a), 256).alias("line_sha256"))


def _requests(rows: DataFrame) -> DataFrame:
    """Three ranges of each thread: near its begin, of no length, and beyond any end."""
    return rows.select("thread_id").distinct().select("thread_id", F.explode(F.array(
        F.struct((F.col("thread_id") % 37 + 5).alias("off"), F.lit(48).cast("long").alias("n")), F.struct(F.lit(3).cast("long").alias("off"), F.lit(0).cast("long").alias("n")),
        F.struct(F.lit(1 << 40).cast("long").alias("off"), F.lit(1).cast("long").alias("n")))).alias("r")).select("thread_id", "r.*")


@query(CHAINS + """, ask AS (
  SELECT thread_id, thread_id % 37 + 5 AS off, 48 AS n FROM fin UNION ALL SELECT thread_id, 3, 0 FROM fin UNION ALL SELECT thread_id, 1099511627776, 1 FROM fin)
SELECT thread_id, off, n, CASE WHEN off + n <= strlen(state) THEN substr(hex(encode(state)), 2 * off + 1, 2 * n) END AS bytes_hex,
  CASE WHEN off + n > strlen(state) THEN 'OutOfRange' END AS error FROM ask JOIN fin USING (thread_id)""")
def range_read(spark, sf_dir):
    rows = chains(spark, sf_dir)
    return checkpoints.read_ranges(checkpoints.extents(rows, KEYS, "checkpoint_no"), _requests(rows), KEYS)


@query(CHAINS + """SELECT thread_id, i AS chunk_no, least(256, strlen(state) - 256 * i) AS chunk_len, sha256(unhex(substr(hex(encode(state)), 512 * i + 1, 512))) AS chunk_sha256
FROM (SELECT thread_id, state, unnest(range(0, (strlen(state) + 255) // 256)) AS i FROM fin)""")
def chunk_stream(spark, sf_dir):
    rows = chains(spark, sf_dir)
    last = rows.groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("checkpoint_no", "message"))), lambda x: x["message"]).alias("m"))
    return checkpoints.chunks(last.select("thread_id", canon.state(F.col("m")).alias("state")), KEYS, 256)


@query("SELECT conv_id AS thread_id, turn AS checkpoint_no FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 100")
def list_recent(spark, sf_dir):
    rows = chains(spark, sf_dir).select("thread_id", "checkpoint_no")
    return checkpoints.recent(rows, ["thread_id", "checkpoint_no"], [F.desc("thread_id"), F.desc("checkpoint_no")])


@query("""SELECT conv_id AS thread_id, turn AS checkpoint_no, CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN 'Deleted' ELSE 'Found' END AS status FROM conversations
UNION ALL SELECT DISTINCT conv_id, turn + 100, 'NotFound' FROM conversations""")
def lookup_status(spark, sf_dir):
    """Every checkpoint and as many that were never there, where the threads of some were cut behind their second turn."""
    rows = chains(spark, sf_dir).select("thread_id", "checkpoint_no")
    gone = rows.filter("thread_id % 5 = 0 and checkpoint_no >= 2")
    asked = rows.unionByName(rows.select("thread_id", (F.col("checkpoint_no") + 100).alias("checkpoint_no")))
    return checkpoints.lookup(rows.join(gone, ["thread_id", "checkpoint_no"], "left_anti"), gone, asked, ["thread_id", "checkpoint_no"])


@query(CHAINS + "SELECT count(*) AS checked, count(*) FILTER (WHERE checkpoint_no = 3) AS failures FROM st")
def verify_counts(spark, sf_dir):
    """All states against expected lengths and digests, of which those of turn 3 are wrong."""
    s = checkpoints.states(chains(spark, sf_dir), KEYS, "checkpoint_no").select("thread_id", "checkpoint_no", "state")
    want = s.select("thread_id", "checkpoint_no", F.octet_length("state").cast("long").alias("state_len"), F.when(F.col("checkpoint_no") == 3, "0").otherwise(F.sha2("state", 256)).alias("state_sha256"))
    return checkpoints.verify(s, want, ["thread_id", "checkpoint_no"])


@query("""SELECT count(*) AS expected, count(*) FILTER (WHERE turn % 4 = 3) AS missing, count(*) FILTER (WHERE turn = 2) AS different FROM conversations""")
def expected_vs_actual(spark, sf_dir):
    """A corpus's messages against a second source: an export's lines, read again, of which some are lost and some changed."""
    rows = chains(spark, sf_dir)
    full = rows.select(F.col("thread_id").alias("t"), F.col("checkpoint_no").alias("n"), F.col("thread_id").cast("string").alias("thread_id"), F.col("checkpoint_no").cast("string").alias("checkpoint_id"), "checkpoint_no", F.lit(None).cast("string").alias("parent_checkpoint_id"), F.array("message").alias("messages"))
    lines = jsonl.export_rows(full).filter("n % 4 <> 3").select("t", "n", F.when(F.col("n") == 2, F.regexp_replace("line", '"role":', '"rôle":')).otherwise(F.col("line")).alias("line"))
    got = lines.select(F.col("t").alias("thread_id"), F.col("n").alias("checkpoint_no"), F.element_at(jsonl.json_elements(F.get_json_object("line", "$.state.messages")), 1).alias("got"))
    return checkpoints.against(rows.select("thread_id", "checkpoint_no", F.col("message").alias("want")), got, ["thread_id", "checkpoint_no"])


@query("""SELECT conv_id AS thread_id, turn AS checkpoint_no, sha256(CAST(to_json({'checkpoint_id': 'c' || turn, 'checkpoint_no': turn, 'parent_checkpoint_id': CASE WHEN turn > 0 THEN 'c' || (turn - 1) END, 'thread_id': 't' || conv_id}) AS VARCHAR)[:-2] || ',"state":' || state || '}') AS line_sha256
FROM (SELECT conv_id, turn, '{"messages":[' || string_agg(CAST(to_json({'content': text, 'role': role}) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn) || ']}' AS state FROM conversations)""")
def export_rows(spark, sf_dir):
    w = checkpoints.chain(["t"], "n")
    rows = chains(spark, sf_dir).select(F.col("thread_id").alias("t"), F.col("checkpoint_no").alias("n"), "message")
    full = rows.select(
        "t", "n", F.concat(F.lit("t"), "t").alias("thread_id"), F.concat(F.lit("c"), "n").alias("checkpoint_id"), F.col("n").alias("checkpoint_no"),
        F.when(F.col("n") > 0, F.concat(F.lit("c"), F.col("n") - 1)).alias("parent_checkpoint_id"), F.collect_list("message").over(w).alias("messages"))
    return jsonl.export_rows(full).select(F.col("t").alias("thread_id"), F.col("n").alias("checkpoint_no"), F.sha2("line", 256).alias("line_sha256"))


@query("SELECT conv_id AS thread_id, turn AS checkpoint_no, sha256(CAST(to_json({'content': text, 'role': role}) AS VARCHAR)) AS delta_sha256, 1 AS n FROM conversations")
def import_delta(spark, sf_dir):
    """Deltas recovered from full states."""
    w = checkpoints.chain(["t"], "n")
    rows = chains(spark, sf_dir).select(F.col("thread_id").alias("t"), F.col("checkpoint_no").alias("n"), "message")
    full = rows.select("t", "n", F.col("t").cast("string").alias("thread_id"), F.col("n").cast("string").alias("checkpoint_id"), F.when(F.col("n") > 0, (F.col("n") - 1).cast("string")).alias("parent_checkpoint_id"), F.collect_list("message").over(w).alias("messages"))
    d = jsonl.import_states(written(full))
    return d.filter("error is null").select(F.col("t").alias("thread_id"), F.col("n").alias("checkpoint_no"), F.sha2(F.array_join("delta", ","), 256).alias("delta_sha256"), F.size("delta").alias("n"))


@query("SELECT conv_id AS thread_id, turn AS checkpoint_no, 't' || conv_id AS thread, 'c' || turn AS checkpoint FROM conversations")
def binding_lookup(spark, sf_dir):
    """Bindings encoded and decoded again."""
    rows = chains(spark, sf_dir).select("thread_id", "checkpoint_no", canon.decode_binding(canon.encode_binding(F.concat(F.lit("t"), "thread_id"), F.concat(F.lit("c"), "checkpoint_no"))).alias("b"))
    return rows.select("thread_id", "checkpoint_no", F.col("b.thread_id").alias("thread"), F.col("b.checkpoint_id").alias("checkpoint"))


@query("""SELECT conv_id AS thread_id, count(*) AS n, sha256(string_agg(CAST(to_json({'content': CASE WHEN role = 'system' THEN 'be ' || conv_id ELSE text END, 'role': role}) AS VARCHAR), ',' ORDER BY turn)) AS messages_sha256 FROM conversations GROUP BY conv_id""")
def normalize_trajectories(spark, sf_dir):
    raw = F.struct("role", "text", F.when(F.col("role") == "system", F.concat(F.lit("be "), "thread_id")).otherwise("").alias("system_prompt"))
    t = chains(spark, sf_dir).groupBy("thread_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("checkpoint_no", raw.alias("m")))), lambda x: x["m"])).alias("trajectory"))
    return t.select("thread_id", corpus.normalize_swe(F.col("trajectory")).alias("m")).select("thread_id", F.size("m").cast("long").alias("n"), F.sha2(F.array_join("m", ","), 256).alias("messages_sha256"))


@query("""SELECT conv_id AS thread_id, turn AS checkpoint_no, CASE role
  WHEN 'assistant' THEN CAST(to_json({'content': text, 'role': role, 'tool_calls': NULL}) AS VARCHAR)
  ELSE CAST(to_json({'content': text, 'role': role}) AS VARCHAR) END AS message FROM conversations""")
def normalize_role_keys(spark, sf_dir):
    t = chains(spark, sf_dir).select("thread_id", "checkpoint_no", F.to_json(F.array(F.struct("role", F.col("text").alias("content"), F.lit("u").alias("name")))).alias("t"))
    return t.select("thread_id", "checkpoint_no", F.element_at(corpus.normalize_hands(F.col("t")), 1).alias("message"))


# Forests --------------------------------------------------------------------------------------------------------------------


def nodes(spark: SparkSession, sf_dir: str, shape: str = "heap") -> DataFrame:
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, sf_dir, "events").withColumn("node", rn)
    up = {"heap": F.expr("node div 2"), "chain": F.col("node") - 1, "flat": F.lit(1).cast("long")}[shape]
    return e.select(F.col("user_id").alias("thread"), "node", F.when(F.col("node") > 1, up).alias("parent"), "event_id", "event_type", F.coalesce(F.octet_length("props"), F.lit(0)).cast("long").alias("bytes"))


def nodes_sql(shape: str = "heap") -> str:
    up = {"heap": "node // 2", "chain": "node - 1", "flat": "1"}[shape]
    return f"""
WITH RECURSIVE ev AS (SELECT user_id AS thread, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node, event_id, event_type, coalesce(strlen(props), 0) AS bytes FROM events),
nodes AS (SELECT *, CASE WHEN node > 1 THEN {up} END AS parent FROM ev),
way AS (SELECT thread, node, 1 AS depth, bytes AS total, event_type AS path, CASE WHEN event_id % 3 = 0 THEN node END AS marked, node = 2 AS below FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.thread, n.node, w.depth + 1, w.total + n.bytes, w.path || '/' || n.event_type, CASE WHEN n.event_id % 3 = 0 THEN n.node ELSE w.marked END, n.node = 2 OR w.below
  FROM nodes n JOIN way w ON n.thread = w.thread AND n.parent = w.node),
fan AS (SELECT thread, parent, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY ALL)
"""


GEOMETRY = """SELECT (SELECT count(DISTINCT thread) FROM nodes) AS thread_count, (SELECT count(*) FROM nodes) AS checkpoint_count, (SELECT count(*) FROM nodes WHERE parent IS NULL) AS root_count,
  (SELECT count(*) FROM nodes) - (SELECT count(*) FROM fan) AS leaf_count, (SELECT count(*) FROM fan WHERE children > 1) AS branch_point_count, (SELECT max(children) FROM fan) AS maximum_fanout,
  max(depth) AS maximum_depth, CAST(sum(15 + total + depth - 1) AS BIGINT) AS logical_state_bytes FROM way"""


def _geometry(shape: str):
    def f(spark, sf_dir):
        return forest.geometry(nodes(spark, sf_dir, shape), "bytes")

    f.__name__ = f"geometry_{shape}"
    query(nodes_sql(shape) + GEOMETRY)(f)


for _shape in ("chain", "heap", "flat"):
    _geometry(_shape)


@query(nodes_sql() + "SELECT children, count(*) AS parents FROM fan GROUP BY children")
def fanout(spark, sf_dir):
    return forest.fanout(nodes(spark, sf_dir)).groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


@query(nodes_sql() + "SELECT thread, max(depth) AS max_depth, CAST(sum(depth) AS BIGINT) AS sum_depth FROM way GROUP BY thread")
def depth(spark, sf_dir):
    return forest.depths(nodes(spark, sf_dir)).groupBy("thread").agg(F.max("depth").alias("max_depth"), F.sum("depth").alias("sum_depth"))


@query(nodes_sql() + "SELECT thread, node, nth FROM (SELECT thread, node, parent, row_number() OVER (PARTITION BY thread, parent ORDER BY event_id) AS nth FROM nodes WHERE parent IS NOT NULL) WHERE nth > 1")
def fork_appends(spark, sf_dir):
    return forest.fork_appends(nodes(spark, sf_dir), "event_id").select("thread", "node", "nth")


@query(nodes_sql() + "SELECT thread, node, strlen(path) AS len, sha256(path) AS sha256 FROM way")
def ancestor_concat_recursive(spark, sf_dir):
    """Every node's concatenation from its root, over branching histories."""
    way = forest.concatenated(nodes(spark, sf_dir), "event_type", "/")
    return way.select("thread", "node", F.octet_length("value").cast("long").alias("len"), F.sha2("value", 256).alias("sha256"))


@query(nodes_sql() + "SELECT thread, node, marked FROM way")
def mirrored_parents(spark, sf_dir):
    """The nearest ancestor that was mirrored."""
    return forest.nearest_marked(nodes(spark, sf_dir), F.col("event_id") % 3 == 0).select("thread", "node", F.col("value").alias("marked"))


@query(nodes_sql() + "SELECT thread, node, row_number() OVER (PARTITION BY thread ORDER BY node) - 1 AS ordinal FROM way WHERE NOT below")
def prune_heap_subtree(spark, sf_dir):
    left, _ = forest.prune(nodes(spark, sf_dir), F.col("node") == 2, "node")
    return left.select("thread", "node", "ordinal")


@query(nodes_sql() + """SELECT n.thread, count(*) AS live, CAST(sum(CASE WHEN n.node % 3 = 0 AND n.node > 20 THEN 2 * n.bytes ELSE n.bytes END) AS BIGINT) AS bytes
FROM nodes n JOIN way w USING (thread, node) WHERE NOT w.below GROUP BY n.thread""")
def live_minus_tombstones(spark, sf_dir):
    """A sealed base overlaid by a hot suffix that repeats some of it with other bytes, less tombstones: the suffix wins."""
    every = nodes(spark, sf_dir)
    _, gone = forest.prune(every, F.col("node") == 2, "node")
    base, hot = every.filter("node <= 40"), every.filter("node > 40 or node % 3 = 0 and node > 20").withColumn("bytes", F.when((F.col("node") % 3 == 0) & (F.col("node") > 20), 2 * F.col("bytes")).otherwise(F.col("bytes")))
    return forest.overlaid(base, hot, gone).groupBy("thread").agg(F.count(F.lit(1)).alias("live"), F.sum("bytes").alias("bytes"))


@query(nodes_sql() + "SELECT thread, node, row_number() OVER (ORDER BY thread, node) - 1 AS pos FROM way WHERE below")
def sorted_tombstones(spark, sf_dir):
    """Tombstones of a pruned subtree in order of their keys."""
    _, gone = forest.prune(nodes(spark, sf_dir), F.col("node") == 2, "node")
    return history.dense_ids(gone, "thread", "pos", then=("node",)).select("thread", "node", "pos")


@query("""WITH k AS (SELECT DISTINCT conv_id || '/' || turn AS key FROM conversations)
SELECT key, sha256(key) AS hash, row_number() OVER (ORDER BY sha256(key), key) - 1 AS pos FROM k""")
def route_index(spark, sf_dir):
    """Where an index in order of (hash, key) finds each checkpoint."""
    return history.route_index(chains(spark, sf_dir).select(F.concat_ws("/", "thread_id", "checkpoint_no").alias("key")).distinct()).select("key", "hash", "pos")


@query(nodes_sql() + "SELECT m.* FROM (" + GEOMETRY + """) g, LATERAL (VALUES
  ('palimpsest_checkpoints', 'gauge', 'Current committed checkpoints.', checkpoint_count), ('palimpsest_threads', 'gauge', 'Current threads.', thread_count),
  ('palimpsest_roots', 'gauge', 'Checkpoints without a parent.', root_count), ('palimpsest_leaves', 'gauge', 'Checkpoints without a child.', leaf_count),
  ('palimpsest_branch_points', 'gauge', 'Checkpoints with several children.', branch_point_count), ('palimpsest_maximum_fanout', 'gauge', 'Most children of a checkpoint.', maximum_fanout),
  ('palimpsest_maximum_depth', 'gauge', 'Longest way to a root.', maximum_depth), ('palimpsest_logical_state_bytes', 'gauge', 'Bytes of all states.', logical_state_bytes)) m(name, kind, help, value)""")
def prom_metrics(spark, sf_dir):
    return metrics.gauges(forest.geometry(nodes(spark, sf_dir), "bytes"))


# Corpus -----------------------------------------------------------------------------------------------------------------------


def attempts(spark: SparkSession, sf_dir: str, instance: str = "lang") -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col(instance).alias("instance_id"))
    solved = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("solved"))
    return d.join(solved, "doc_id", "left").select(
        "instance_id", F.col("doc_id").alias("attempt_id"), F.coalesce("solved", F.lit(False)).alias("solved"),
        F.transform(F.split("text", "\n"), lambda x: canon.message(F.lit("user"), x)).alias("messages"))


def corpus_sql(instance: str = "lang") -> str:
    return f"""
WITH RECURSIVE line AS (SELECT {instance} AS instance_id, doc_id AS attempt_id, unnest(l) AS content, generate_subscripts(l, 1) AS depth FROM (SELECT {instance}, doc_id, string_split(text, chr(10)) AS l FROM documents)),
msg AS (SELECT *, CAST(to_json({{'content': content, 'role': 'user'}}) AS VARCHAR) AS message FROM line),
seen AS (SELECT instance_id, attempt_id, depth, message, 15 + sum(strlen(message)) OVER w + depth - 1 AS state_len, sha256(string_agg(sha256(message), ',') OVER w) AS node
  FROM msg WINDOW w AS (PARTITION BY instance_id, attempt_id ORDER BY depth)),
trie AS (SELECT instance_id, node, any_value(depth) AS depth, any_value(state_len) AS state_len, count(*) AS observations FROM seen GROUP BY ALL),
solved AS (SELECT doc_id AS attempt_id, max(quality) = 1 AS solved FROM labels GROUP BY doc_id),
per AS (SELECT instance_id, attempt_id, count(*) AS checkpoints, max(state_len) AS final_bytes, sum(state_len) AS cumulative_bytes FROM seen GROUP BY ALL),
prof AS (SELECT instance_id, count(*) AS attempts, count(*) FILTER (WHERE solved) AS solved_attempts, CAST(sum(checkpoints) AS BIGINT) AS checkpoints, CAST(sum(final_bytes) AS BIGINT) AS final_bytes, CAST(sum(cumulative_bytes) AS BIGINT) AS cumulative_bytes
  FROM per LEFT JOIN solved USING (attempt_id) GROUP BY instance_id)
"""


@query(corpus_sql() + "SELECT * FROM prof")
def profile_instances(spark, sf_dir):
    return corpus.profile(attempts(spark, sf_dir))


@query(corpus_sql() + "SELECT instance_id, coalesce(max(depth) FILTER (WHERE observations = attempts), 0) AS common_prefix FROM trie JOIN prof USING (instance_id) GROUP BY instance_id")
def common_prefix(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return corpus.common_prefix(a, corpus.trie(corpus.observations(a)))


@query(corpus_sql("source") + "SELECT CAST(t AS INT) AS threshold, count(*) FILTER (WHERE attempts >= t) AS instances FROM prof, (SELECT unnest([2, 4, 8, 16, 32, 64]) AS t) GROUP BY t")
def fanout_thresholds(spark, sf_dir):
    return corpus.fanout_thresholds(corpus.profile(attempts(spark, sf_dir, "source")))


@query(corpus_sql("source") + "SELECT instance_id, attempts, sha256(instance_id) AS id_sha256 FROM prof ORDER BY attempts DESC, id_sha256 LIMIT 25")
def top_instances(spark, sf_dir):
    return corpus.top_instances(corpus.profile(attempts(spark, sf_dir, "source"))).select("instance_id", "attempts", "id_sha256")


SEED, REVISION = "palimpsest-selection", "r0"


@query(f"SELECT source AS instance_id, row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || '{REVISION}' || chr(0) || source)) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)")
def seeded_order(spark, sf_dir):
    """Instances in a pseudo-random order that a seed fixes."""
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("instance_id")).distinct()
    return history.dense_ids(ids.withColumn("rank", corpus.seeded("instance_id", SEED, REVISION)), "rank", "pos", then=("instance_id",)).select("instance_id", "pos")


FILL = [("adapter", 100_000, 1), ("engineering", 400_000, 4), ("evaluation", 400_000, 5), ("holdout", 400_000, 5)]


@query(corpus_sql("source") + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || '{REVISION}' || chr(0) || instance_id)) AS pos FROM prof WHERE attempts >= 4),
part AS (SELECT * FROM (VALUES (1, 'adapter', 100000, 1), (2, 'engineering', 400000, 4), (3, 'evaluation', 400000, 5), (4, 'holdout', 400000, 5)) v(k, name, target, least)),
fill AS (SELECT pos, 1 AS k, cumulative_bytes AS bytes, 1 AS n FROM ranked WHERE pos = 1
  UNION ALL SELECT r.pos, f.k + (f.bytes >= p.target AND f.n >= p.least)::INT, CASE WHEN f.bytes >= p.target AND f.n >= p.least THEN 0 ELSE f.bytes END + r.cumulative_bytes, CASE WHEN f.bytes >= p.target AND f.n >= p.least THEN 0 ELSE f.n END + 1
  FROM fill f JOIN part p ON p.k = f.k JOIN ranked r ON r.pos = f.pos + 1)
SELECT instance_id, ranked.pos, part.name AS partition FROM fill JOIN ranked USING (pos) JOIN part USING (k)""")
def partition_fill(spark, sf_dir):
    out = corpus.fill_partitions(corpus.profile(attempts(spark, sf_dir, "source")), FILL, SEED, REVISION, 4)
    return out.select("instance_id", "pos", "partition")


@query(corpus_sql() + "SELECT instance_id, depth, count(*) AS nodes, CAST(sum(state_len) AS BIGINT) AS state_bytes FROM trie GROUP BY ALL")
def trie_nodes(spark, sf_dir):
    t = corpus.trie(corpus.observations(attempts(spark, sf_dir)))
    return t.groupBy("instance_id", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum("state_len").alias("state_bytes"))


STATS = "SELECT instance_id, CAST(sum(observations) AS BIGINT) AS observed_nodes, count(*) AS unique_nodes, CAST(sum(observations) - count(*) AS BIGINT) AS shared_observations, CAST(sum(observations * state_len) AS BIGINT) AS observed_bytes, CAST(sum(state_len) AS BIGINT) AS unique_bytes FROM trie GROUP BY instance_id"


@query(corpus_sql() + STATS)
def trie_stats(spark, sf_dir):
    return corpus.trie_stats(corpus.trie(corpus.observations(attempts(spark, sf_dir))))


@query(corpus_sql() + "SELECT instance_id, observations, count(*) AS nodes FROM trie GROUP BY ALL")
def trie_observations(spark, sf_dir):
    return corpus.trie(corpus.observations(attempts(spark, sf_dir))).groupBy("instance_id", "observations").agg(F.count(F.lit(1)).alias("nodes"))


@query(corpus_sql() + "SELECT count(*) FILTER (WHERE observations > 1) AS shared_nodes, count(*) AS nodes FROM trie")
def shared_nodes(spark, sf_dir):
    t = corpus.trie(corpus.observations(attempts(spark, sf_dir)))
    return t.agg(F.count_if(F.col("observations") > 1).alias("shared_nodes"), F.count(F.lit(1)).alias("nodes"))


@query(corpus_sql() + """SELECT instance_id, 'Totals' AS fault, 1 AS n FROM prof WHERE instance_id = 'de'
UNION ALL SELECT instance_id, f, count(*) FROM trie, (SELECT unnest(['NodeDigest', 'StateLength']) AS f) WHERE instance_id = 'en' AND depth = 2 GROUP BY ALL
UNION ALL SELECT instance_id, 'PathEdge', count(*) FROM seen WHERE instance_id = 'fr' AND depth = 3 GROUP BY ALL""")
def corpus_verify(spark, sf_dir):
    """Every check of a frozen corpus, whose totals are wrong for one instance, messages for another, steps for a third."""
    seen = written(corpus.observations(attempts(spark, sf_dir)))
    t = written(corpus.trie(seen))
    seen = seen.withColumn("parent", F.when((F.col("instance_id") == "fr") & (F.col("depth") == 3), "x").otherwise(F.col("parent")))
    t = t.withColumn("message", F.when((F.col("instance_id") == "en") & (F.col("depth") == 2), F.concat("message", F.lit(" "))).otherwise(F.col("message")))
    given = corpus.trie_stats(t).withColumn("unique_nodes", F.col("unique_nodes") + F.when(F.col("instance_id") == "de", 1).otherwise(0))
    return corpus.corpus_faults(t, seen, given)


@query("""SELECT lang, doc_id, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_sha256, CAST(sum(strlen(line)) AS BIGINT) AS logical_bytes
FROM (SELECT lang, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY ALL""")
def cas_dedup_join(spark, sf_dir):
    """Lines stored once by digest and joined back to the chains that use them: every text comes out as it was."""
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("digest", F.sha2("line", 256))
    blobs = written(lines.groupBy("digest").agg(F.first("line").alias("blob")))
    return corpus.joined_back(lines.drop("line"), blobs, ["lang", "doc_id"], "at").select("lang", "doc_id", "lines", F.sha2("text", 256).alias("text_sha256"), "logical_bytes")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), old AS (SELECT digest, min(doc_id) AS doc_id FROM d WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT digest, doc_id, false AS inserted FROM old
UNION ALL SELECT digest, min(doc_id), true FROM d WHERE doc_id % 3 > 0 AND digest NOT IN (SELECT digest FROM old) GROUP BY 1""")
def insert_if_absent(spark, sf_dir):
    """A content-addressed table after a batch was put into it: digests that it holds stay as they are, others come once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    held = written(d.filter("doc_id % 3 = 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    return corpus.inserted_if_absent(held, d.filter("doc_id % 3 > 0"), "digest", "doc_id")


# Statistics ---------------------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT l_returnflag, list_sort(list(CAST(round(l_extendedprice) AS BIGINT))) AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n AS count, x[1] AS min, """ + ", ".join(f"x[CAST(round_even({f} * (n - 1), 0) AS BIGINT) + 1] AS p{int(f * 100)}" for f in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", x[n] AS max FROM v")
def pct_nearest(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round("l_extendedprice").cast("long").alias("x"))
    return corpus.distribution(v, ["l_returnflag"], "x")


@query("SELECT l_returnflag, CAST(round_even(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(CAST(l_quantity AS DOUBLE), 0.95), 0) AS BIGINT) AS p95 FROM lineitem GROUP BY 1")
def pct_linear(spark, sf_dir):
    return stats.linear(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p95": 0.95})


@query("""WITH v AS (SELECT l_returnflag, list_sort(list(CAST(round(l_extendedprice) AS BIGINT))) AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, x[(n - 1) * 50 // 100 + 1] AS p50, x[(n - 1) * 95 // 100 + 1] AS p95, x[(n - 1) * 99 // 100 + 1] AS p99 FROM v""")
def pct_floor(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round("l_extendedprice").cast("long").alias("x"))
    return stats.at_ranks(v, ["l_returnflag"], "x", {f"p{p}": (lambda n, p=p: stats.floor_index(n, p)) for p in (50, 95, 99)})


@query("""WITH v AS (SELECT o_orderpriority, list_sort(list(CAST(round(o_totalprice) AS BIGINT))) AS x, count(*) AS n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, n, s / n AS mean, x[(n - 1) * 50 // 100 + 1] AS p50, x[(n - 1) * 95 // 100 + 1] AS p95, x[(n - 1) * 99 // 100 + 1] AS p99, x[n] AS max FROM v""")
def latency_stats(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderpriority", F.round("o_totalprice").cast("long").alias("x"))
    ranks = stats.at_ranks(v, ["o_orderpriority"], "x", {f"p{p}": (lambda n, p=p: stats.floor_index(n, p)) for p in (50, 95, 99)} | {"max": lambda n: n - 1})
    mean = v.groupBy("o_orderpriority").agg((F.sum("x") / F.count("x")).alias("mean"))
    return ranks.join(mean, "o_orderpriority")


@query("""WITH s AS (SELECT event_id % 4096 AS slot, arg_max(CAST(round(value) AS BIGINT), event_id) AS x FROM events GROUP BY 1), v AS (SELECT list_sort(list(x)) AS x, count(*) AS n FROM s)
SELECT n AS sampled, x[(n - 1) // 2 + 1] AS p50, x[CAST(floor((n - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95, (SELECT count(*) FROM events) AS callbacks FROM v""")
def shadow_metrics(spark, sf_dir):
    """Percentiles over a cyclic sample of 4096 slots, each with its latest value."""
    e = table(spark, sf_dir, "events")
    slots = e.groupBy((F.col("event_id") % 4096).alias("slot")).agg(F.max_by(F.round("value").cast("long"), "event_id").alias("x"))
    got = stats.at_ranks(slots, [], "x", {"p50": lambda n: stats.shadow_index(n, 0.5), "p95": lambda n: stats.shadow_index(n, 0.95)})
    return got.select(F.col("n").alias("sampled"), "p50", "p95").join(e.agg(F.count(F.lit(1)).alias("callbacks")))


RATIOS = """WITH s AS (SELECT c_mktsegment, CAST(sum(CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN c_nationkey >= 12 AND c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS b FROM customer GROUP BY 1)
"""


def _ratios(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_nationkey") < 12).alias("a"), F.count_if((F.col("c_nationkey") >= 12) & (F.col("c_mktsegment") != "BUILDING")).alias("b"))
    return c.withColumn("ratio", stats.ratio(F.col("a"), F.col("b")))


@query(RATIOS + "SELECT c_mktsegment, a, b, CASE WHEN b <> 0 THEN CAST(a AS DOUBLE) / b END AS ratio FROM s")
def ratios(spark, sf_dir):
    return _ratios(spark, sf_dir)


@query(RATIOS + "SELECT c_mktsegment, coalesce(b <> 0 AND CAST(a AS DOUBLE) / b >= 0.9, false) AS at_least, coalesce(b <> 0 AND CAST(a AS DOUBLE) / b <= 2.0, false) AS at_most FROM s")
def thresholds(spark, sf_dir):
    return _ratios(spark, sf_dir).select("c_mktsegment", stats.at_least(F.col("ratio"), 0.9).alias("at_least"), stats.at_most(F.col("ratio"), 2.0).alias("at_most"))


# Histories of versions --------------------------------------------------------------------------------------------------------------


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation log: per user a root, then forks, appends, splices and expiries on a heap of parents; some invalid."""
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")).withColumn("m", F.when(F.col("rn") == 1, 9).otherwise(F.col("event_id") % 7))
    e = e.select("user_id", "rn", "m", "event_id", "event_type", (2 * F.col("event_id") + 1).alias("seq"))
    up = e.select("user_id", F.col("rn").alias("up"), F.col("seq").alias("parent_seq"))
    e = e.withColumn("up", F.expr("if(rn > 1, rn div 2, null)")).join(up, ["user_id", "up"], "left")
    m, none = F.col("m"), F.lit(None)
    ops = e.select(
        "seq", F.when(m == 0, "fork").when(m.isin(1, 2), "append").when(m == 5, "expire").otherwise("splice").alias("op"), F.col("user_id").alias("history_id"),
        F.when(m != 5, F.col("parent_seq")).alias("parent_seq"), F.when(m.isin(3, 4), F.col("event_id") % 11).otherwise(0).cast("long").alias("offset"),
        F.when(m.isin(3, 4), F.col("event_id") % 4).when(m == 6, 1).otherwise(0).cast("long").alias("delete_len"),
        F.when(m.isin(9, 1, 2, 3), F.encode(F.concat("event_type", F.col("event_id").cast("string")), "UTF-8")).alias("insert"), none.cast("binary").alias("request_id"), none.cast("binary").alias("binding"),
        none.cast("binary").alias("target"), F.when(m == 5, F.col("parent_seq")).alias("target_seq"))
    made = ops.groupBy("history_id").agg((F.min("seq") - 1).alias("seq"))
    return ops.unionByName(made.withColumn("op", F.lit("create")), allowMissingColumns=True)


OPS = """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 2 * event_id + 1 AS seq FROM events),
op AS (SELECT user_id AS h, rn, seq, CASE WHEN rn > 1 THEN rn // 2 END AS up, CASE WHEN rn = 1 THEN 9 ELSE event_id % 7 END AS m, event_id % 11 AS o3, event_id % 4 AS d3, event_type || event_id AS t FROM e),
expire AS (SELECT h, up AS rn, min(seq) AS gone FROM op WHERE m = 5 GROUP BY ALL),
v AS (SELECT h, rn, seq, m, t AS c, list_resize([]::BIGINT[], strlen(t), seq) AS src FROM op WHERE rn = 1
  UNION ALL SELECT h, rn, seq, m, c[1:off] || ins || c[off + del + 1:], src[1:off] || list_resize([]::BIGINT[], strlen(ins), seq) || src[off + del + 1:] FROM (
    SELECT o.h, o.rn, o.seq, o.m, v.c, v.src, CASE WHEN o.m IN (1, 2) THEN length(v.c) WHEN o.m IN (3, 4) THEN o.o3 ELSE 0 END AS off, CASE WHEN o.m IN (3, 4) THEN o.d3 WHEN o.m = 6 THEN 1 ELSE 0 END AS del, CASE WHEN o.m IN (1, 2, 3) THEN o.t ELSE '' END AS ins
    FROM op o JOIN v ON o.h = v.h AND o.up = v.rn LEFT JOIN expire x ON x.h = v.h AND x.rn = v.rn WHERE o.m <> 5 AND (x.gone IS NULL OR x.gone > o.seq))
  WHERE off <= length(c) AND del <= length(c) - off AND (m = 0 OR del > 0 OR ins <> '') AND length(c) - del + length(ins) > 0),
ver AS (SELECT v.*, x.gone IS NULL AS retained FROM v LEFT JOIN expire x ON x.h = v.h AND x.rn = v.rn),
leaf AS (SELECT h, seq, t, strlen(t) AS size FROM v JOIN op USING (h, rn, seq) WHERE v.m IN (9, 1, 2, 3)),
live AS (SELECT DISTINCT h, unnest(src) AS seq FROM ver WHERE retained)
"""


def _versions(spark, sf_dir, digests: bool = False, pieces: bool = False) -> DataFrame:
    return history.with_lifecycle(written(history.replay(operations(spark, sf_dir), digests, pieces=pieces)))


def _leaves(spark, sf_dir, versions: DataFrame) -> DataFrame:
    """(history_id, leaf, payload, size) of committed operations that brought bytes."""
    ops = operations(spark, sf_dir).filter("insert is not null").select("history_id", F.col("seq").alias("leaf"), F.col("insert").alias("payload"), F.octet_length("insert").cast("long").alias("size"))
    return ops.join(versions.select("history_id", F.col("seq").alias("leaf")), ["history_id", "leaf"], "left_semi")


@query(OPS + "SELECT h AS history_id, seq, CASE WHEN m = 0 THEN 'Forked' ELSE 'Committed' END AS outcome, strlen(c) AS len, sha256(c) AS sha256, retained FROM ver")
def splice_replay(spark, sf_dir):
    """All versions that an operation log commits, by content digest."""
    return _versions(spark, sf_dir, digests=True).select("history_id", "seq", "outcome", "len", "sha256", "retained")


@query(OPS + "SELECT h AS history_id, seq, row_number() OVER (ORDER BY seq) - 1 AS version_id FROM v")
def version_ids(spark, sf_dir):
    """Dense store-wide ids in order of commitment."""
    return history.dense_ids(_versions(spark, sf_dir), "seq", "version_id").select("history_id", "seq", "version_id")


@query(OPS + "SELECT h AS history_id, seq, strlen(c) AS len FROM v WHERE m = 0")
def fork_len(spark, sf_dir):
    return _versions(spark, sf_dir).filter("outcome = 'Forked'").select("history_id", "seq", "len")


@query(OPS + "SELECT v.h AS history_id, v.seq, strlen(v.c) AS len, strlen(v.c) - strlen(p.c) AS appended FROM v JOIN v p ON p.h = v.h AND p.rn = v.rn // 2 WHERE v.m IN (1, 2)")
def append_len(spark, sf_dir):
    v = _versions(spark, sf_dir)
    p = v.select("history_id", F.col("seq").alias("parent_seq"), F.col("len").alias("before"))
    return v.filter("op = 'append'").join(p, ["history_id", "parent_seq"]).select("history_id", "seq", "len", (F.col("len") - F.col("before")).alias("appended"))


@query(OPS + """SELECT o.h AS history_id, o.seq, CASE WHEN v.rn IS NULL THEN 'UnknownVersion' WHEN row_number() OVER (PARTITION BY o.h, o.up ORDER BY o.seq) = 1 THEN 'Expired' ELSE 'AlreadyExpired' END AS outcome
FROM op o LEFT JOIN v ON v.h = o.h AND v.rn = o.up WHERE o.m = 5""")
def expire_outcomes(spark, sf_dir):
    ops = operations(spark, sf_dir).filter("op = 'expire'").select("history_id", "seq", "target_seq")
    return history.expire_outcomes(ops, _versions(spark, sf_dir).select("history_id", "version_seq")).select("history_id", "seq", "outcome")


@query(OPS + """SELECT leaf.h AS history_id, count(*) AS leaves_before, count(live.seq) AS leaves_after, count(*) - count(live.seq) AS leaves_reclaimed, CAST(sum(size) AS BIGINT) AS bytes_before, CAST(coalesce(sum(size) FILTER (WHERE live.seq IS NOT NULL), 0) AS BIGINT) AS bytes_after
FROM leaf LEFT JOIN live ON live.h = leaf.h AND live.seq = leaf.seq GROUP BY leaf.h""")
def gc_reachable(spark, sf_dir):
    return history.collect_garbage(history.live_leaves(operations(spark, sf_dir)), _leaves(spark, sf_dir, _versions(spark, sf_dir)).drop("payload"))


@query(OPS + """SELECT h AS history_id, seq AS leaf, row_number() OVER w - 1 AS new_leaf, CAST(sum(size) OVER w - size AS BIGINT) AS new_offset FROM leaf SEMI JOIN live USING (h, seq) WINDOW w AS (PARTITION BY h ORDER BY seq)""")
def repack_offsets(spark, sf_dir):
    live = history.live_leaves(operations(spark, sf_dir))
    return history.repack(_leaves(spark, sf_dir, _versions(spark, sf_dir)).drop("payload"), live).select("history_id", "leaf", "new_leaf", "new_offset")


@query(OPS + """SELECT h AS history_id, seq, seq % 5 AS off, 9 AS n, CASE WHEN retained AND seq % 5 + 9 <= strlen(c) THEN hex(encode(substr(c, seq % 5 + 1, 9))) END AS bytes_hex,
  CASE WHEN NOT retained THEN 'VersionExpired' WHEN seq % 5 + 9 > strlen(c) THEN 'OutOfRange' END AS error FROM ver""")
def version_read(spark, sf_dir):
    asked = _versions(spark, sf_dir).select("history_id", "seq", (F.col("seq") % 5).alias("off"), F.lit(9).cast("long").alias("n"))
    return history.read_log(history.as_steps(operations(spark, sf_dir)), asked)


@query("""SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'Fresh' WHEN event_type = first_value(event_type) OVER w THEN 'Replayed' ELSE 'Conflict' END AS outcome
FROM events WINDOW w AS (PARTITION BY user_id, event_id % 20 ORDER BY event_id)""")
def request_classify(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "user_id", F.col("event_id") % 20).alias("request_id"), F.col("event_type").alias("digest"))
    return history.classify_requests(r, seq="event_id").select("event_id", "outcome")


@query("SELECT event_type || '-' || user_id AS binding, min(event_id) AS first_seq, count(*) AS requests, row_number() OVER (ORDER BY min(event_id)) - 1 AS history_id FROM events GROUP BY 1")
def bound_history_upsert(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", "user_id").alias("binding"), F.col("event_id").alias("seq"))
    return history.bound_histories(r)


@query("""WITH r AS (SELECT event_type || '-' || user_id AS k, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1)
SELECT k AS request_id, CASE WHEN first % 3 = 0 THEN 'Unknown' WHEN last % 2 = 0 THEN 'Active' ELSE 'Retired' END AS state FROM r""")
def receipt_status(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(F.concat_ws("-", "event_type", "user_id").alias("request_id")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    receipts = r.filter("a % 3 <> 0").select("request_id", F.when(F.col("b") % 2 == 0, "Active").otherwise("Retired").alias("state"))
    return history.receipt_status(receipts, r.select("request_id"))


# Compaction, layouts, evidence ----------------------------------------------------------------------------------------------------------


@query(nodes_sql() + ", up AS (SELECT thread, node, parent FROM nodes WHERE event_id % 5 = 0 UNION SELECT n.thread, n.node, n.parent FROM nodes n JOIN up u ON n.thread = u.thread AND n.node = u.parent) SELECT thread, node, parent FROM up")
def compact_with_ancestry(spark, sf_dir):
    """Versions that live checkpoints need when ancestry is kept."""
    n = nodes(spark, sf_dir)
    return compaction.keep_ancestry(n, n.filter("event_id % 5 = 0")).select("thread", "node", "parent")


@query(nodes_sql() + "SELECT n.thread, n.node, p.node AS parent FROM nodes n LEFT JOIN nodes p ON p.thread = n.thread AND p.node = n.parent AND p.event_id % 5 = 0 WHERE n.event_id % 5 = 0")
def compact_referenced(spark, sf_dir):
    """Versions that live checkpoints reference directly; lost parents become null."""
    n = nodes(spark, sf_dir)
    return compaction.keep_referenced(n, n.filter("event_id % 5 = 0")).select("thread", "node", "parent")


@query(OPS + "SELECT h AS history_id, count(DISTINCT seq) AS leaves FROM (SELECT h, unnest(src) AS seq FROM ver WHERE rn % 2 = 1) GROUP BY h")
def image_export(spark, sf_dir):
    """Leaves in an image of some roots."""
    v = written(_versions(spark, sf_dir, pieces=True))
    roots = operations(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("history_id").orderBy("seq")) - 1).filter("rn % 2 = 1").select("history_id", "seq")
    _, used = compaction.export_image(v, _leaves(spark, sf_dir, v), roots)
    return used.groupBy("history_id").agg(F.count(F.lit(1)).alias("leaves"))


@query(OPS + """SELECT DISTINCT h AS history_id, v.seq, 'MissingLeaf' AS fault FROM (SELECT h, seq, unnest(src) AS leaf FROM ver) v WHERE leaf % 13 = 0
UNION ALL SELECT h, seq, 'Length' FROM ver WHERE seq % 11 = 0 AND NOT list_contains(list_transform(src, lambda x: x % 13 = 0), true)""")
def version_verify(spark, sf_dir):
    """Structural faults of all versions, where some leaves are lost and some lengths are wrong."""
    v = written(_versions(spark, sf_dir, pieces=True))
    broken = v.withColumn("len", F.col("len") + F.when(F.col("seq") % 11 == 0, 1).otherwise(0))
    return compaction.image_faults(broken, _leaves(spark, sf_dir, v).filter("leaf % 13 <> 0"))


@query(OPS + """SELECT o.h AS history_id, count(*) + 1 AS operations, count(v.seq) AS versions_allocated, count(*) FILTER (WHERE v.m IN (9, 1, 2, 3)) AS leaves_allocated,
  CAST(coalesce(sum(strlen(o.t)) FILTER (WHERE v.m IN (9, 1, 2, 3)), 0) AS BIGINT) AS payload_bytes_written, CAST(sum(coalesce(strlen(v.c), 0)) AS BIGINT) AS logical_bytes
FROM op o LEFT JOIN v USING (h, rn, seq) GROUP BY o.h""")
def work_counters(spark, sf_dir):
    """What a replay allocated and wrote, by history."""
    log = operations(spark, sf_dir)
    done = history.work(history.replay(log, False, pieces=False), log)
    return done.withColumns({c: F.col(c).cast("long") for c in ("payload_bytes_written", "logical_bytes")})


# Request ledgers and bindings: root splices under request ids that come again, expiries, retirements, bound versions.
LEDGER = """
WITH e AS (SELECT *, user_id AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 2 * event_id + 1 AS seq, event_id % 10 AS m, event_id % 7 AS q FROM events),
op AS (SELECT h, rn, seq, m, event_type AS t, CASE WHEN m < 8 THEN q END AS q, event_id % 5 AS b, lag(seq, 1 + CAST(event_id % 3 AS INT)) OVER (PARTITION BY h ORDER BY rn) AS target FROM e),
fresh AS (SELECT h, q, seq, t FROM (SELECT *, row_number() OVER (PARTITION BY h, q ORDER BY seq) AS nth FROM op WHERE m < 6) WHERE nth = 1),
bound AS (SELECT h, b, min(seq) AS seq FROM op WHERE m = 9 GROUP BY ALL),
made AS (SELECT h, seq FROM fresh UNION ALL SELECT h, seq FROM bound),
expiry AS (SELECT o.h, o.target AS seq, min(o.seq) AS gone FROM op o JOIN made v ON v.h = o.h AND v.seq = o.target WHERE o.m = 8 GROUP BY ALL),
ended AS (SELECT f.h, f.q, least(min(o.seq), any_value(x.gone)) AS retired FROM fresh f LEFT JOIN op o ON o.h = f.h AND o.q = f.q AND o.m IN (6, 7) AND o.seq > f.seq LEFT JOIN expiry x ON x.h = f.h AND x.seq = f.seq GROUP BY ALL),
done AS (SELECT o.h AS history_id, o.seq, o.m, CASE
    WHEN o.m < 6 AND f.seq = o.seq THEN 'Committed' WHEN o.m < 6 AND f.t <> o.t THEN 'RequestConflict' WHEN o.m < 6 AND d.retired < o.seq THEN 'Retired' WHEN o.m < 6 THEN 'Replayed'
    WHEN o.m < 8 AND f.seq < o.seq AND (d.retired IS NULL OR d.retired >= o.seq) THEN 'RequestRetired' WHEN o.m < 8 THEN 'UnknownRequest'
    WHEN o.m = 8 AND (v.seq IS NULL OR o.target IS NULL) THEN 'UnknownVersion' WHEN o.m = 8 AND x.gone = o.seq THEN 'Expired' WHEN o.m = 8 THEN 'AlreadyExpired'
    WHEN n.seq = o.seq THEN 'Committed' ELSE 'DuplicateBinding' END AS outcome
  FROM op o LEFT JOIN fresh f ON f.h = o.h AND f.q = o.q LEFT JOIN ended d ON d.h = o.h AND d.q = o.q LEFT JOIN made v ON o.m = 8 AND v.h = o.h AND v.seq = o.target AND v.seq < o.seq
    LEFT JOIN expiry x ON o.m = 8 AND x.h = o.h AND x.seq = o.target LEFT JOIN bound n ON o.m = 9 AND n.h = o.h AND n.b = o.b)
"""


def requests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (2 * F.col("event_id") + 1).alias("seq"), (F.col("event_id") % 10).alias("m"))
    w, m, none = W.partitionBy("user_id").orderBy("event_id"), F.col("m"), F.lit(None)
    back = F.col("event_id") % 3
    target = F.when(back == 0, F.lag("seq", 1).over(w)).when(back == 1, F.lag("seq", 2).over(w)).otherwise(F.lag("seq", 3).over(w))
    request = F.encode((F.col("event_id") % 7).cast("string"), "UTF-8")
    ops = e.select(
        "seq", F.when(m.isin(6, 7), "retire").when(m == 8, "expire").otherwise("splice").alias("op"), F.col("user_id").alias("history_id"), none.cast("long").alias("parent_seq"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("delete_len"), F.when(~m.isin(6, 7, 8), F.encode("event_type", "UTF-8")).alias("insert"), F.when(m < 6, request).alias("request_id"),
        F.when(m == 9, F.encode(F.concat(F.lit("b"), F.col("event_id") % 5), "UTF-8")).alias("binding"), F.when(m.isin(6, 7), request).alias("target"), F.when(m == 8, target).alias("target_seq"))
    made = ops.groupBy("history_id").agg((F.min("seq") - 1).alias("seq"))
    return ops.unionByName(made.withColumn("op", F.lit("create")), allowMissingColumns=True)


def _decided(spark, sf_dir) -> DataFrame:
    """history_id, seq, op, outcome: of rejected operations the error."""
    return history.replay(requests_log(spark, sf_dir), False, pieces=False).filter("op <> 'create'").withColumn("outcome", F.coalesce("error", "outcome"))


@query(LEDGER + "SELECT history_id, seq, outcome FROM done WHERE m NOT IN (6, 7)")
def request_ledger(spark, sf_dir):
    """Outcomes of requests that come fresh, again, changed, after retirement; of expiries and of bound versions."""
    return _decided(spark, sf_dir).filter("op <> 'retire'").select("history_id", "seq", "outcome")


@query(LEDGER + "SELECT history_id, seq, outcome FROM done WHERE m IN (6, 7)")
def retire_outcomes(spark, sf_dir):
    """Retirements of active requests, and of those that aren't (any more)."""
    return _decided(spark, sf_dir).filter("op = 'retire'").select("history_id", "seq", "outcome")


@query(LEDGER + """SELECT b.h AS history_id, 'b' || b.b AS binding, 1 AS off, 3 AS n, CASE WHEN x.gone IS NULL THEN hex(encode(substr(o.t, 2, 3))) END AS bytes_hex, CASE WHEN x.gone IS NOT NULL THEN 'VersionExpired' END AS error
FROM bound b JOIN op o ON o.h = b.h AND o.seq = b.seq LEFT JOIN expiry x ON x.h = b.h AND x.seq = b.seq
UNION ALL SELECT DISTINCT h, 'none', 1, 3, NULL, 'NotFound' FROM op""")
def binding_reads(spark, sf_dir):
    """Bytes read through the names that versions were bound to."""
    log = written(requests_log(spark, sf_dir))
    v = written(history.with_lifecycle(history.replay(log, False)).join(log.select("history_id", "seq", "binding"), ["history_id", "seq"]))
    leaves = log.filter("insert is not null").select("history_id", F.col("seq").alias("leaf"), F.col("insert").alias("payload"))
    named = v.filter("binding is not null").select("history_id", "binding").unionByName(v.select("history_id", F.encode(F.lit("none"), "UTF-8").alias("binding")).distinct())
    got = history.read_bound(v, leaves, named.select("*", F.lit(1).cast("long").alias("off"), F.lit(3).cast("long").alias("n")))
    return got.withColumn("binding", F.decode("binding", "UTF-8"))


HORIZON = 5
EVICTION = f"""
WITH op AS (SELECT user_id AS h, event_id AS id, 2 * event_id + 1 AS seq, event_id % 3 = 0 AS retire, lag(event_id, 1 + CAST(event_id % 8 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events),
fresh AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) AS nth FROM op WHERE NOT retire),
asked AS (SELECT o.h, o.seq, f.id, f.id IS NOT NULL AND (SELECT count(*) FROM fresh n WHERE n.h = o.h AND n.nth > f.nth AND n.seq < o.seq) < {HORIZON} AS known FROM op o LEFT JOIN fresh f ON f.h = o.h AND f.id = o.target WHERE o.retire),
won AS (SELECT *, known AND row_number() OVER (PARTITION BY h, id, known ORDER BY seq) = 1 AS done FROM asked)
"""


def eviction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, text = W.partitionBy("user_id").orderBy("event_id"), lambda c: F.encode(c.cast("string"), "UTF-8")
    back = F.col("event_id") % 8
    target = F.coalesce(*[F.when(back == i, F.lag("event_id", i + 1).over(w)) for i in range(8)])
    e, retire = table(spark, sf_dir, "events"), F.col("event_id") % 3 == 0
    ops = e.select(
        (2 * F.col("event_id") + 1).alias("seq"), F.when(retire, "retire").otherwise("splice").alias("op"), F.col("user_id").alias("history_id"), F.lit(None).cast("long").alias("parent_seq"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("delete_len"), F.when(~retire, text(F.col("event_id"))).alias("insert"), F.when(~retire, text(F.col("event_id"))).alias("request_id"), F.lit(None).cast("binary").alias("binding"),
        F.when(retire, F.coalesce(text(target), text(F.lit("none")))).alias("target"), F.lit(None).cast("long").alias("target_seq"))
    made = ops.groupBy("history_id").agg((F.min("seq") - 1).alias("seq"))
    return ops.unionByName(made.withColumn("op", F.lit("create")), allowMissingColumns=True)


@query(EVICTION + "SELECT h AS history_id, seq, CASE WHEN done THEN 'RequestRetired' ELSE 'UnknownRequest' END AS outcome FROM won")
def receipt_eviction(spark, sf_dir):
    """Retirements where only the newest five receipts of a history are known."""
    return history.replay(eviction_log(spark, sf_dir), False, HORIZON, pieces=False).filter("op = 'retire'").select("history_id", "seq", F.coalesce("error", "outcome").alias("outcome"))


@query(EVICTION + f"""SELECT f.h AS history_id, CAST(f.id AS VARCHAR) AS request_id, CASE WHEN w.id IS NULL THEN 'Active' ELSE 'Retired' END AS state
FROM (SELECT *, max(nth) OVER (PARTITION BY h) AS newest FROM fresh) f LEFT JOIN (SELECT DISTINCT h, id FROM won WHERE done) w ON w.h = f.h AND w.id = f.id WHERE f.nth > newest - {HORIZON}""")
def receipt_horizon(spark, sf_dir):
    """The receipts that a ledger of five a history still holds after all operations."""
    return history.receipts(history.as_steps(eviction_log(spark, sf_dir)), HORIZON).withColumn("request_id", F.decode("request_id", "UTF-8"))


@query(CHAINS + """, ext AS (SELECT thread_id, checkpoint_no, strlen(message) + CASE WHEN checkpoint_no = 0 THEN 13 ELSE 1 END + CASE WHEN checkpoint_no = max(checkpoint_no) OVER (PARTITION BY thread_id) THEN 2 ELSE 0 END AS len FROM msg),
seg AS (SELECT thread_id, checkpoint_no, sum(len) OVER (PARTITION BY thread_id ORDER BY checkpoint_no) - len AS st, len FROM ext)
SELECT thread_id, checkpoint_no AS ord FROM seg WHERE 150 >= st AND 150 < st + len""")
def covering_segment(spark, sf_dir):
    """The message that byte 150 of each state lies in."""
    rows = chains(spark, sf_dir)
    return compaction.covering_segment(rows.select("thread_id").distinct(), checkpoints.extents(rows, KEYS, "checkpoint_no").withColumnRenamed("ord", "checkpoint_no").drop("payload"), KEYS, F.lit(150)).join(
        checkpoints.extents(rows, KEYS, "checkpoint_no").select("thread_id", "ord", F.col("st").alias("seg_st")), ["thread_id", "seg_st"]).select("thread_id", "ord")


@query(CHAINS + """, cas AS (SELECT thread_id, CAST(sum(strlen(message)) AS BIGINT) AS cas_bytes FROM (SELECT DISTINCT thread_id, message FROM msg) GROUP BY 1)
SELECT thread_id, CAST(sum(strlen(state)) AS BIGINT) AS snapshot_bytes, CAST(sum(strlen(message)) AS BIGINT) AS delta_bytes, any_value(cas_bytes) AS cas_bytes,
  CAST(sum(strlen(state)) AS DOUBLE) / sum(strlen(message)) AS snapshot_over_delta, CAST(sum(strlen(state)) AS DOUBLE) / any_value(cas_bytes) AS snapshot_over_cas FROM st JOIN cas USING (thread_id) GROUP BY thread_id""")
def storage_layouts(spark, sf_dir):
    return evidence.layouts(chains(spark, sf_dir), KEYS, "checkpoint_no")


@query("SELECT o_orderkey AS id, 'b' || (o_orderkey % 3) AS backend, o_orderkey % 2 = 0 AS pass, CASE WHEN o_orderkey % 5 > 0 THEN 1000 + o_orderkey - 10 END AS marginal_bytes, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey ELSE 77 END AS read_p50_ns FROM orders")
def evidence_projection(spark, sf_dir):
    """Nested run reports, cut to flat records."""
    k = F.col("o_orderkey").cast("string")
    read = F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit('"reopened":{"read_latency":{"p50_ns":'), k, F.lit("}},"))).otherwise("")
    empty = F.when(F.col("o_orderkey") % 5 > 0, F.lit(',"empty":{"allocated_bytes":10}')).otherwise("")
    doc = F.concat(
        F.lit('{"result":{"backend":"b'), (F.col("o_orderkey") % 3).cast("string"), F.lit('","pass":'), (F.col("o_orderkey") % 2 == 0).cast("string"), F.lit(',"storage":{"reopened":{"allocated_bytes":'), (F.col("o_orderkey") + 1000).cast("string"), F.lit("}"), empty,
        F.lit('},"exactness":{'), read, F.lit('"reopened_after_aggressive_pack":{"read_latency":{"p50_ns":77}}}}}'))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evidence.run_figures(doc).alias("r"))
    return r.select("id", "r.backend", "r.pass", "r.marginal_bytes", "r.read_p50_ns")


@query("SELECT conv_id AS thread_id, count(*) + count(*) FILTER (WHERE role = 'user') AS n, sha256(string_agg(CASE WHEN role = 'user' THEN text || '|' || role ELSE text END, '|' ORDER BY turn)) AS value_sha256 FROM conversations GROUP BY conv_id")
def delta_reducer(spark, sf_dir):
    """A list channel from batches of one or two values."""
    b = chains(spark, sf_dir).select("thread_id", "checkpoint_no", F.when(F.col("role") == "user", F.array("text", "role")).otherwise(F.array("text")).alias("batch"))
    return evidence.reduced(b, KEYS, "checkpoint_no").select("thread_id", F.size("value").cast("long").alias("n"), F.sha2(F.array_join("value", "|"), 256).alias("value_sha256"))


@query("SELECT 'm' || (event_id // 2) AS logical_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def recover_configs(spark, sf_dir):
    """Checkpoints recovered by their metadata."""
    meta = F.concat(F.lit('{"source":"'), F.when(F.col("event_id") % 3 == 0, "loop").otherwise("input"), F.lit('","canonical_checkpoint_id":"m'), F.expr("cast(event_id div 2 as string)"), F.lit('"}'))
    rows, _ = evidence.recovered(table(spark, sf_dir, "events").select(meta.alias("metadata"), F.col("event_id").alias("config")))
    return rows.groupBy("logical_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS mark, md5(CAST(event_id AS VARCHAR)) AS object_id FROM events WHERE event_id % 4 <> 0")
def mark_lookup(spark, sf_dir):
    """Marks of an import and the objects they became."""
    e = F.col("event_id").cast("string")
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("# "), e)).otherwise(F.concat(F.lit(":"), e, F.lit(" "), F.md5(e.cast("binary")))).alias("value"))
    return evidence.parsed_marks(lines)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id ELSE sha256('r0' || chr(0) || event_type || chr(0) || event_id) END AS attempt_id FROM events")
def attempt_ids(spark, sf_dir):
    """Natural attempt ids, and digests of where a row stands."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("instance_id"), "event_type", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), "event_id")).otherwise("").alias("natural"))
    return corpus.attempt_ids(e, "natural", REVISION, "event_type", "event_id").select("event_id", "attempt_id")


@query("SELECT user_id AS history_id, event_type AS binding, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def binding_uniqueness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("history_id"), F.col("event_type").alias("binding"))
    return evidence.repeated_bindings(e)


@query("""SELECT o_orderpriority AS run, bool_and(o_totalprice > 1500) AS all_exact, count(DISTINCT (o_orderkey % 2, o_orderstatus = 'F')) = 1 AS counts_equal FROM orders WHERE o_custkey % 50 < 2 GROUP BY 1
UNION ALL SELECT 'same', true, true""")
def backend_agreement(spark, sf_dir):
    """By run: whether all arms are exact and count alike."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 50 < 2")
    arms = o.select(F.col("o_orderpriority").alias("run"), (F.col("o_totalprice") > 1500).alias("exact"), (F.col("o_orderkey") % 2).alias("checkpoints"), (F.col("o_orderstatus") == "F").cast("int").alias("attempts"))
    same = spark.range(3).select(F.lit("same").alias("run"), F.lit(True).alias("exact"), F.lit(7).cast("long").alias("checkpoints"), F.lit(2).alias("attempts"))
    return evidence.agreement(arms.unionByName(same), ["run"])


@query("""SELECT event_id, [404, 404, 413, 400, 409, 409, 409, 416, 503, 507, 500, 500, 500][event_id % 13 + 1] AS read_status,
  [400, 404, 413, 400, 409, 409, 409, 416, 503, 507, 500, 500, 500][event_id % 13 + 1] AS append_status FROM events""")
def error_status(spark, sf_dir):
    """The status of each of the twelve kinds, and of one that isn't known."""
    kind = F.element_at(F.array(*map(F.lit, [*READ_STATUS, "Other"])), (F.col("event_id") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", evidence.http_status(kind).alias("read_status"), evidence.http_status(kind, True).alias("append_status"))
