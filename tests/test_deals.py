"""What goes wrong on large tables alone: logs whose parts are dealt out in different ways, inputs made again and again."""

import pytest

from palimpsest.operators import forest, history
from palimpsest.plans import queries as plans
from test_queries import SF, duck, normal  # noqa: F401


@pytest.fixture
def apart(spark):
    """Joins few partitions of small shuffles, but none of larger ones."""
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "4k")
    yield spark
    spark.conf.unset(size)


@pytest.mark.parametrize("name", ["append_len", "expire_outcomes", "fork_len", "gc_reachable", "image_export", "repack_offsets", "splice_replay", "version_ids", "version_read", "version_verify", "work_counters"])
def test_log_of_parts(apart, duck, name):  # noqa: F811
    got = plans.QUERIES[name](apart, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name]})").fetchall()
    rows = lambda r: sorted((tuple(map(normal, x)) for x in r), key=repr)
    assert rows(got.select(columns).collect()) == rows(want)


def test_expiries_of_histories_with_the_same_seqs(spark):
    expires = spark.createDataFrame([(1, 9, 3), (2, 9, 3), (2, 11, 3), (3, 9, 3)], "history_id long, seq long, target_seq long")
    versions = spark.createDataFrame([(1, 3), (2, 3)], "history_id long, version_seq long")
    got = history.expire_outcomes(expires, versions).select("history_id", "seq", "outcome").collect()
    assert sorted(map(tuple, got)) == [(1, 9, "Expired"), (2, 9, "Expired"), (2, 11, "AlreadyExpired"), (3, 9, "UnknownVersion")]


def test_geometry_makes_its_nodes_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chain = spark.createDataFrame([(1, n, n - 1 if n > 1 else None, 5) for n in range(1, 10)], "thread long, node long, parent long, bytes long")
    got = forest.geometry(chain.mapInArrow(count, chain.schema), "bytes").first()
    assert (got["maximum_depth"], got["checkpoint_count"], got["maximum_fanout"], got["logical_state_bytes"]) == (9, 9, 1, 9 * 15 + 5 * 45 + 36)
    assert made.value == 9
