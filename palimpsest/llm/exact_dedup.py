"""Exact deduplication by two passes over a Bloom filter; DataFrame functions only.

Pass one counts the cells of a blocked Bloom filter over all text hashes: cells touched twice mark hashes that
may repeat. Pass two tests every row against those cells: rows that surely don't repeat pass straight through,
and only the others shuffle, to be grouped by their SHA-256 and decided exactly.

Both passes go over a narrow table (doc_id, length, digest), range by range of the hash: a range holds about KEYS_A_RANGE
rows, so that its filter keeps its size (32 MB, broadcast) and its rate of false alarms (under 2 %) at any number of rows,
and more rows only make more ranges. A range reads its own pages of the table alone, for its files are sorted by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, bloom_pages, bloom_test, filter_bits, lookup, packed, release, staged, text_or_empty

#: Rows that one filter is for.
KEYS_A_RANGE = 1 << 24


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space; null counts as empty."""
    return F.sha2(F.regexp_replace(text, SPACE_RUN, ""), 256)


def _groups(candidates: DataFrame) -> DataFrame:
    """By pal_sha: id and length of the row that stays (most code points, then smallest id, null ids last), the
    group's size, and how many rows have that id and length. The first grouping spreads a hot text over its ids."""
    rank = F.struct((-F.col("pal_len")).alias("len"), F.col("pal_id").isNull().alias("none"), F.col("pal_id").alias("id"))
    once = candidates.groupBy("pal_sha", "pal_len", "pal_id").agg(F.count(F.lit(1)).alias("same"))
    best = F.min(F.struct(rank.alias("rank"), F.col("same")))
    return once.groupBy("pal_sha").agg(best.alias("b"), F.sum("same").alias("pal_size")).select(
        "pal_sha", F.col("b.rank.id").alias("pal_keep"), (-F.col("b.rank.len")).alias("pal_keep_len"), F.col("b.same").alias("pal_same"), "pal_size")


def _digests(docs: DataFrame) -> DataFrame:
    """The narrow table of all rows, each file of it in order of hash."""
    rows = docs.select(F.col("doc_id").alias("pal_id"), F.char_length(text_or_empty()).alias("pal_len"), digest(text_or_empty()).alias("pal_sha"))
    return staged(rows.withColumn("pal_h", F.xxhash64("pal_sha")).sortWithinPartitions("pal_h"), "digests")


def _tested(digests: DataFrame, n: int) -> DataFrame:
    """digests with pal_maybe: false only where no other row has the hash."""
    ranges = max(1, -(-n // KEYS_A_RANGE))
    width = (1 << 64) // ranges + 1
    bits = filter_bits(-(-n // ranges))
    out = None
    for i in range(ranges):
        lo, hi = -(1 << 63) + i * width, min(-(1 << 63) + (i + 1) * width, 1 << 63)
        own = digests.filter((F.col("pal_h") >= lo) & (F.col("pal_h") <= hi - 1)) if ranges > 1 else digests
        pages = staged(bloom_pages(own.select(F.col("pal_h").alias("h")), bits, 2), "repeated")
        tested = bloom_test(own, "pal_h", pages, bits, "pal_maybe")
        if ranges > 1:  # one filter at a time
            tested = staged(tested, "tested")
            release(pages)
        out = tested if out is None else out.unionByName(tested)
    return out


def verdicts(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Texts are equal if identical without white space. Null texts equal empty ones. Null doc_ids rank last and
    are kept only by a group that has no other. Rows that repeat a doc_id and its text get the same verdict.
    An empty table gives an empty result; other columns are ignored. Texts of any length count whole, and don't shuffle.
    """
    digests = _digests(docs)
    n = digests.count()
    tested = _tested(digests, n)
    alone = tested.filter(~F.col("pal_maybe")).select(
        F.col("pal_id").alias("doc_id"), F.col("pal_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("pal_sha").alias("text_sha256"))
    maybe = tested.filter("pal_maybe").select("pal_id", "pal_len", "pal_sha")
    groups = staged(_groups(maybe), "groups")
    decided = lookup(maybe, groups, "pal_sha", "pal_size", n).select(
        F.col("pal_id").alias("doc_id"), F.col("pal_keep").alias("keep_id"), F.col("pal_size").alias("group_size"),
        _stays(F.col("pal_id"), F.col("pal_len")).alias("kept"), F.col("pal_sha").alias("text_sha256"))
    return alone.unionByName(decided)


def _stays(doc_id: Column, length: Column) -> Column:
    return doc_id.eqNullSafe(F.col("pal_keep")) & (length == F.col("pal_keep_len"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each distinct text, also where rows repeat.

    Null texts equal empty ones, null doc_ids rank last, and of rows alike in text and doc_id any one stays. An empty table
    gives an empty result; other columns stay, whatever their names, and texts of any length count whole. The groups are
    known from verdicts' passes; of the texts only those shuffle whose hash a filter of the repeated ones holds (256 MB at
    most, for some 10^8 repeated texts at under 2 % false alarms; beyond that more of them shuffle).
    """
    digests = _digests(docs)
    n = digests.count()
    maybe = _tested(digests, n).filter("pal_maybe").select("pal_id", "pal_len", "pal_sha")
    groups = staged(_groups(maybe).filter("pal_size > 1"), "groups")
    release(digests)
    bits = filter_bits(groups.count())
    pages = staged(bloom_pages(groups.select(F.xxhash64("pal_sha").alias("h")), bits, 1), "groups-filter")
    rows = packed(docs, pal_id=F.col("doc_id"), pal_len=F.char_length(text_or_empty()), pal_sha=digest(text_or_empty()))
    tested = bloom_test(rows.withColumn("pal_h", F.xxhash64("pal_sha")), "pal_h", pages, bits, "pal_maybe")
    repeated = staged(tested.filter("pal_maybe").select("row", "pal_id", "pal_len", "pal_sha"), "candidates")
    kept = lookup(repeated, groups, "pal_sha", "pal_size", n, "left").filter(F.col("pal_size").isNull() | _stays(F.col("pal_id"), F.col("pal_len")))
    return (
        tested.filter("not pal_maybe").select("row.*")
        .unionByName(kept.filter("pal_size is null or pal_same = 1").select("row.*"))  # no size: a false alarm
        .unionByName(kept.filter("pal_same > 1").dropDuplicates(["pal_sha"]).select("row.*"))
    )
