"""Window functions, with GROUPS frames and frame exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], agg, start: int, end: int, name: str) -> DataFrame:
    """agg over a frame of peer groups from ``start`` to ``end`` of the current one."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")
    over = Window.partitionBy(*partition).orderBy("_peers").rangeBetween(start, end)
    return df.withColumn("_peers", rank).withColumn(name, agg.over(over)).drop("_peers")


def excluding(value: Column, over, exclude: str, partition: list[str], order: list[Column]) -> tuple[Column, Column]:
    """(sum, count) over the frame without the current row, its peer group, or its ties.

    The excluded rows must lie inside the frame.
    """
    total, n = F.sum(value).over(over), F.count(value).over(over)
    own, own_n = F.coalesce(value, F.lit(0)), value.isNotNull().cast("long")
    peers = Window.partitionBy(*partition, *order)
    group, group_n = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    if exclude == "current row":
        out, out_n = own, own_n
    elif exclude == "group":
        out, out_n = group, group_n
    else:
        out, out_n = group - own, group_n - own_n
    return F.when(n - out_n > 0, total - out), n - out_n


R.sql("W2_row_number", f"SELECT o_orderkey, CAST(row_number() {OVER} AS INT) AS r FROM orders")
R.sql("W3_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r FROM part")
R.sql("W4_dense_rank", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r FROM part")
R.sql("W5_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
R.sql("W6_cume_dist", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
R.sql("W7_ntile", f"SELECT o_orderkey, CAST(ntile(4) {OVER} AS INT) AS r FROM orders")
R.sql("W8_lag", f"SELECT o_orderkey, lag(o_orderkey, 2, -1) {OVER} AS r FROM orders")
R.sql("W9_lead", f"SELECT o_orderkey, lead(o_totalprice) {OVER} AS r FROM orders")
R.sql("W10_first_value", f"SELECT o_orderkey, first_value(o_orderkey) {OVER} AS r FROM orders")
R.sql("W11_last_value", "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM orders")
R.sql("W12_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 3) {OVER} AS r FROM orders")
R.sql("W13_aggregate_over", f"SELECT o_orderkey, {'CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) ' + OVER + ' AS DOUBLE)'} AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
R.sql("W13_nested", "SELECT o_custkey, CAST(sum(count(*)) OVER (PARTITION BY o_custkey % 10 ORDER BY o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey")
R.sql("W14_rows_frame", "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM orders")
R.sql("W14_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n FROM part")
R.sql("W14_interval_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders")
R.sql("W17_moving_average", "SELECT o_orderkey, round(avg(CAST(o_orderkey AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS m FROM orders")


@R.frame("W1_window_api", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INT) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def _api(t):
    w = Window.partitionBy("s_nationkey")
    return t.supplier.select("s_suppkey", F.rank().over(w.orderBy(F.desc("s_acctbal"))).alias("r"), F.count("*").over(w).alias("n"))


@R.frame("W15_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def _groups(t):
    return groups_frame(t.part, ["p_brand"], [F.col("p_size")], F.count("*"), -1, 1, "n").select("p_partkey", "n")


def _excluded(kind: str, name: str) -> None:
    frame = "PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    @R.frame(name, f"SELECT p_partkey, CAST(sum(p_size) OVER ({frame} EXCLUDE {kind.upper()}) AS BIGINT) AS s, count(p_size) OVER ({frame} EXCLUDE {kind.upper()}) AS n FROM part")
    def run(t):
        over = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(Window.unboundedPreceding, 0)
        s, n = excluding(F.col("p_size"), over, kind, ["p_brand"], [F.col("p_size")])
        return t.part.select("p_partkey", s.cast("long").alias("s"), n.alias("n"))


for _kind in ("current row", "group", "ties"):
    _excluded(_kind, f"W16_exclude_{_kind.split(' ')[0]}")
