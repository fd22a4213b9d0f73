"""A pipeline from raw documents to packed sequences: STAGES in order, each written as Parquet and reread by the next.

Part of the subpackage llm. All stages but the last return the columns of documents, whatever others there are. Null and
repeated doc_ids and repeated rows are documents like others; null texts count as empty; texts of any length are read whole;
an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, langid, packing, resemblance, secrets
from palimpsest.llm.common import release, scratch, staged
from palimpsest.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those whose code in every learned language is longer
    than their bytes."""
    return langid.accept(docs, langid.learn(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text that is identical without white space: most code points, then smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of documents alike in 0.8 of their runs of five words, or within four bits of
    SimHash (operator 4's trie join): the one with the smallest doc_id."""
    return resemblance.deduplicate(docs, words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and completed credentials in the texts; keeps every document."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences of 2048."""
    return packing.with_crc32(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", deduplicate),
    ("simhash_near_dedup", near_deduplicate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Code lengths, fingerprints, spans and packing aren't expressible in SQL; tests compare run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents' tokens. What a stage read and its own scratch tables go once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            following = staged(stage(spark, docs, sf_dir), name, keep=True)
        release(docs)
        docs = following
    return docs
