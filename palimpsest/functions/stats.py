"""The four percentile definitions, which differ, and guarded ratios.

Values are counted before they are ordered, so that repeated values cost nothing, and exact ranks are read off running
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import dropped, written

#: Slices of a range of values, and ranges that are broadcast at most (16 MB).
BUCKETS, MOST_RANGES = 4096, 1 << 18


def nearest(n: Column, f: float) -> Column:
    """Rank (from 0) of the nearest index, halves to even."""
    return F.bround(F.lit(f) * (n - 1)).cast("long")


def floor_index(n: Column, percent: int) -> Column:
    return F.floor((n - 1) * percent / 100).cast("long")


def shadow_index(n: Column, f: float) -> Column:
    return F.floor((n - 1) * F.lit(f)).cast("long")


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, object]) -> DataFrame:
    """By keys: n, and for each name the numeric value at the rank (from 0) that ranks[name](n) gives.

    One shuffle counts distinct values, with map-side combining. Then each rank's range of values is cut into BUCKETS equal
    slices, and the slice that holds the rank is its next range, until it holds one value: nothing is sorted but at most
    BUCKETS counts, no task holds a hot key's values, and outliers only cost a round more."""
    counted = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("c_")))
    whole = counted.groupBy(*keys).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.sum("c_").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("at")) for name, rank in ranks.items()]))
    wanted = written(whole.filter("n > 0").select(*keys, "n", "lo_", "hi_", each.alias("x")).select(*keys, "n", "lo_", "hi_", F.col("x.name").alias("name_"), F.col("x.at").alias("at_")))
    same = [*keys, "lo_", "hi_"]
    while not wanted.filter("lo_ < hi_").isEmpty():
        ranges = wanted.filter("lo_ < hi_").select(*same).distinct()
        if not keys or ranges.count() <= MOST_RANGES:  # otherwise they are joined by hash
            ranges = F.broadcast(ranges)
        inside = (counted.join(ranges, keys) if keys else counted.join(ranges)).filter("v_ between lo_ and hi_")
        slice_ = F.floor((F.col("v_") - F.col("lo_")) * (BUCKETS - 1) / (F.col("hi_") - F.col("lo_")))
        slices = inside.groupBy(*same, slice_.alias("slice_")).agg(F.sum("c_").alias("in_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
        before = F.sum("in_").over(W.partitionBy(*same).orderBy("slice_").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_")
        held = wanted.filter("lo_ < hi_").join(slices.withColumn("before_", before), same).filter("at_ >= before_ and at_ < before_ + in_")
        narrower = held.select(*keys, "n", F.col("least_").alias("lo_"), F.col("most_").alias("hi_"), "name_", (F.col("at_") - F.col("before_")).alias("at_"))
        following = written(wanted.filter("lo_ = hi_").unionByName(narrower))
        dropped(wanted)
        wanted = following
    return wanted.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name_") == name, F.col("lo_"))).alias(name) for name in ranks])


def linear(df: DataFrame, keys: list[str], value: str, marks: dict[str, float]) -> DataFrame:
    """By keys: for each name the value at a fraction of the ranks, by linear interpolation and rounded half to even."""
    place = lambda n, f: F.lit(f) * (n - 1)
    ranks = {f"{name}_{end}": (lambda n, f=f, to=to: to(place(n, f))) for name, f in marks.items() for end, to in (("lo", F.floor), ("hi", F.ceil))}
    got = at_ranks(df, keys, value, ranks)
    between = lambda name, f: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(F.col("n"), f) - F.floor(place(F.col("n"), f)))
    return got.select(*keys, *[F.bround(between(name, f)).cast("long").alias(name) for name, f in marks.items()])


def ratio(a: Column, b: Column) -> Column:
    """Null on a zero or missing denominator."""
    return F.try_divide(a.cast("double"), b)


def at_least(x: Column, bound: float) -> Column:
    return F.coalesce(x >= bound, F.lit(False))


def at_most(x: Column, bound: float) -> Column:
    return F.coalesce(x <= bound, F.lit(False))
