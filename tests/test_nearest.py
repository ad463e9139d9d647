"""The nearest-neighbour join gives DuckDB's rows on odd values, without all pairs of a key."""

import random

import duckdb
import pytest

from lattica.operators.joins import nearest_join
from lattica.plans import catalog

FINITE = [0.0, 0.01, 0.02, 1.0, 2.5, -3.0, 7.25]
KINDS = {
    "plain": FINITE,
    "odd": [*FINITE, None, float("nan"), float("inf"), float("-inf")],
    # the differences to the small ones are all rounded to the same number
    "rounded": [1e17, -1e17, *(i / 100 for i in range(40))],
}


def write(spark, path, values, n_left=60, n_right=90, nations=(0, 1, 2, None)):
    rng = random.Random(7)
    left = [(i // 2 if i < 20 else i, rng.choice(nations), rng.choice(values)) for i in range(n_left)]
    keys = rng.sample(range(1000), n_right - 3) + [5, 5, None]
    right = [(x, rng.choice(nations), rng.choice(values)) for x in keys]
    right.append((2000, 9, 1.0))
    left.append((500, 9, 2.0))
    for name, rows, p in (("supplier", left, "s_suppkey"), ("customer", right, "c_custkey")):
        c = p[0]
        spark.createDataFrame(rows, f"{p} long, {c}_nationkey int, {c}_acctbal double").coalesce(1).write.parquet(f"{path}/{name}.parquet")


@pytest.mark.parametrize("kind", KINDS)
def test_odd_values_give_the_rows_of_the_sql(spark, tmp_path, kind):
    write(spark, tmp_path, KINDS[kind])
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["J13_nearest"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["J13_nearest"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def most_rows(node):
    """The largest number of rows that a join of an executed plan gave."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return most_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return most_rows(node.plan())
    own = node.metrics().get("numOutputRows")
    kids = node.children()
    return max([own.get().value() if "Join" in name and own.isDefined() else 0, *(most_rows(kids.apply(i)) for i in range(kids.size()))])


def test_pairs_of_a_key_are_not_made(spark):
    left = spark.range(2000).selectExpr("id as s", "1 as sk", "cast(id * 7 % 1000 as double) as sv")
    right = spark.range(2000).selectExpr("id as c", "1 as ck", "cast(id * 3 % 1000 as double) as cv")
    got = nearest_join(left, right, ("sk", "ck"), ("sv", "cv"), 3, "s", "c")
    assert len(got.collect()) == 6000
    assert 6000 <= most_rows(got._jdf.queryExecution().executedPlan()) <= 2000 * 8 * 3
