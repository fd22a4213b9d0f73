"""The queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, langid, licenses, packing, quality, secrets, sharding, simhash
from .common import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc32(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, errors=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digests(chat.format_conversations(given.unionByName(own)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality.learn(stats, table(spark, sf_dir, "labels"))
    return quality.apply_rules(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_license_scan, op3_language_id, op4_simhash_near_dedup, op5_bpe, op6_exact_dedup, op7_secret_scan,
    op8_sharding, op9_chat_format, op10_quality_rules)}


def _license_sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, n, " ".join(licenses.words(t))) for i, (n, t) in enumerate(licenses.TEMPLATES))
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    t = licenses.THRESHOLD
    return rf"""
WITH template AS (SELECT id, name, {grams('w')} AS g FROM (SELECT id, name, string_split(t, ' ') AS w FROM (VALUES {values}) v(id, name, t))),
own AS (SELECT id, unnest(g) AS gram FROM template),
word AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
gram AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM word)),
hit AS (SELECT doc_id, id, i, 2000 * (row_number() OVER w - 1) - {round(t * 1000)} * i AS level FROM gram JOIN own USING (gram) WINDOW w AS (PARTITION BY doc_id, id ORDER BY i)),
first AS (SELECT *, level <= coalesce(min(level) OVER (PARTITION BY doc_id, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), level) AS begins FROM hit),
part AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, id ORDER BY i) AS k FROM first),
span AS (SELECT doc_id, id, min(i) AS lo, arg_max(i, level * 1000000 - i) AS hi FROM part GROUP BY doc_id, id, k),
sized AS (SELECT s.doc_id, name, lo, hi + 1 AS hi, t.g AS own, {grams('w[lo:hi + 1]').replace('w[lo:hi + 1]', 'x')} AS g FROM (SELECT span.*, w[lo:hi + 1] AS x FROM span JOIN word USING (doc_id)) s JOIN template t USING (id)),
hits AS (SELECT doc_id, name, lo, hi, len(own) AS size, 2 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM sized),
good AS (SELECT * FROM hits WHERE dice >= {t}),
stays AS (SELECT doc_id, name, max(dice) AS dice FROM good g WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = g.doc_id AND b.name <> g.name AND b.lo <= g.hi AND g.lo <= b.hi
  AND (b.dice > g.dice OR b.dice = g.dice AND (b.size > g.size OR b.size = g.size AND b.name < g.name))) GROUP BY ALL),
best AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, first(name ORDER BY dice DESC, name) AS best_license, max(dice) AS best_dice FROM stays GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, best_dice FROM documents LEFT JOIN best USING (doc_id)"""


def _chat_sql() -> str:
    t = chat.Template()
    head, tail = t.tails()
    n = lambda m: len(m.open) + len(m.close) + 2
    marks = " ".join(f"WHEN '{r}' THEN {n(m)}" for r, m in t.marks.items())
    escaped = lambda x: f"length(regexp_replace({x}, '({head})(~*){tail}', '\\1~\\2\\3', 'g'))"
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({escaped('text')} + CASE role {marks} ELSE {n(t.role) - 2 + n(t.other)} + {escaped('role')} END) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM whole"""


ORACLES = {
    "op2_license_scan": _license_sql(),
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op9_chat_format": _chat_sql(),
}
