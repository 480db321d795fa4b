"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from laneatlas.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _key(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(_key, r)) for r in rows) == sorted(tuple(_key(r[i]) for i in at) for r in want.fetchall())


def _same(spark, duck, name, path):
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, str(path)).select(*want.columns).collect()
    assert sorted(tuple(map(_key, r)) for r in got) == sorted(tuple(map(_key, r)) for r in want.fetchall())
    return got


def test_rings_just_below_zero_keep_their_sign(spark, tmp_path):
    keys = [24631, 60000, 115369, 0]  # the first ring begins at -1e-14 degrees or so
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    with duckdb.connect() as c:
        c.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
        got = _same(spark, c, "demo_features", tmp_path)
    assert any("-0.000000" in r.ring for r in got)


def test_the_clock_is_not_laid_out_frame_by_frame(spark, tmp_path):
    rows = [(i, 1) for i in (0, 5, 60, 10**12)] + [(7, 2), (10**12 - 10, 3)]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as c:
        c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert len(_same(spark, c, "clocked_lives", tmp_path)) == 3


def test_names():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
