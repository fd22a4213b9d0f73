"""What the training-data operators share: scratch tables, names, a skew-safe lookup and a blocked Bloom filter."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Keys that hold more than one part in so many of all rows are looked up by broadcast: there are at most so many.
HEAVY_KEYS = 1000
#: Bits of one page of the blocked Bloom filter, as bitmap_construct_agg() makes them.
PAGE_BITS = 32768
#: Bits of a filter for each key, and most bits of one filter: 256 MB, so that it may be broadcast.
BITS_A_KEY, MAX_FILTER_BITS = 16, 1 << 31


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs' rows whole, as one struct column `row`, beside columns of our own: no name of docs can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[x.alias(name) for name, x in more.items()])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is set, a temporary one, but in local mode alone (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths of the tables staged within each open scratch(), innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were staged within it, but for those kept: frames over them end with it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared scratch folder: cuts lineage, is computed once, outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the tables of staged() frames that no later job reads."""
    for df in tables:
        if path := getattr(df, "_palimpsest_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of left with right, in which key is unique and `size` counts the key's rows in left.

    Keys with over total / HEAVY_KEYS rows are fewer than HEAVY_KEYS, so they are broadcast and their rows
    don't move; the others have no such key and are joined by hash.
    """
    limit = max(total / HEAVY_KEYS, 1.0)
    heavy = F.broadcast(right.filter(F.col(size) > limit))
    light = right.filter(F.col(size) <= limit)
    return left.join(heavy, key).unionByName(left.join(heavy, key, "left_anti").join(light, key, how))


def filter_bits(n: int) -> int:
    """Bits of a filter for n keys: BITS_A_KEY for each and a power of two, within the bound."""
    bits = PAGE_BITS
    while bits < BITS_A_KEY * n and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def filter_cells(h: Column, bits: int) -> tuple[Column, Column, Column]:
    """Page and two bits in it of a 64-bit hash: all of a key's bits lie in one page."""
    pages = bits // PAGE_BITS
    page = F.shiftrightunsigned(h, 30).bitwiseAND(F.lit(pages - 1).cast("long"))
    return page, h.bitwiseAND(F.lit(PAGE_BITS - 1).cast("long")), F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(PAGE_BITS - 1).cast("long"))


def bloom_pages(hashes: DataFrame, bits: int, at_least: int) -> DataFrame:
    """(pal_page, pal_bits): the cells that at_least of the hashes (column h) touch; at most bits / 8 bytes together.

    Cells are counted with map-side combining, so that a hot hash costs one row a task.
    """
    page, one, two = filter_cells(F.col("h"), bits)
    cells = hashes.select(F.explode(F.array(page * PAGE_BITS + one, page * PAGE_BITS + two)).alias("cell"))
    return (
        cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
        .groupBy(F.shiftrightunsigned("cell", 15).alias("pal_page"))
        .agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(PAGE_BITS - 1).cast("long"))).alias("pal_bits"))
    )


def bloom_test(df: DataFrame, h: str, pages: DataFrame, bits: int, flag: str) -> DataFrame:
    """df with a boolean column `flag`: false only where the hash in column h surely isn't in the filter."""
    page, one, two = filter_cells(F.col(h), bits)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("pal_bits"), (F.shiftrightunsigned(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1

    return (
        df.withColumn("pal_page", page).join(F.broadcast(pages), "pal_page", "left")
        .withColumn(flag, F.col("pal_bits").isNotNull() & is_set(one) & is_set(two)).drop("pal_page", "pal_bits")
    )
