"""Every query against its SQL, over the smallest tables; the DataFrame functions against Python."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import queries as plans

SF = "/root/testdata/sf0.001"


def normal(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda r, names: sorted((tuple(normal(x[names.index(c)]) for c in columns) for x in r), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
