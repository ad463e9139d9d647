"""Every query with SQL gives DuckDB's rows; plans have the shape that they should."""

import os

import duckdb
import pytest

from lattica.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = catalog.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted((tuple(repr(r[c]) for c in cols) for r in got.collect()))
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["SC1_seq_scan"](spark, sf))
    assert "GreaterThan(o_totalprice,250000" in text and "o_custkey" not in text.split("ReadSchema")[1]


def test_bin_join_is_an_equi_join(spark, sf):
    text = plan(catalog.queries()["J11_range_join"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_asof_join_makes_no_pairs(spark, sf):
    assert "Join" not in plan(catalog.queries()["J12_asof_join"](spark, sf))


def test_join_strategies_give_the_same_rows(spark, sf):
    sql = "SELECT /*+ {} */ o_orderkey, c_name FROM orders JOIN customer c ON o_custkey = c_custkey"
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    found = [sorted(map(tuple, spark.sql(sql.format(h)).collect())) for h in ("BROADCAST(c)", "MERGE(c)", "SHUFFLE_HASH(c)", "SHUFFLE_REPLICATE_NL(c)")]
    assert all(f == found[0] for f in found)
