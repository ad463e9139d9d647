"""Aggregation: grouping sets, ordered-set and hypothetical-set aggregates, user-defined ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def array_agg_nulls(value: Column, *order: Column) -> Column:
    """Collect with nulls kept, in the given order."""
    held = F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v")))
    return F.transform(F.sort_array(held) if order else held, lambda x: x.v)


def hypothetical(value: Column, at, kind: str) -> Column:
    """rank, dense_rank, percent_rank or cume_dist of a row with value ``at`` added to the group."""
    below, n = F.count_if(value < at), F.count(value)
    if kind == "rank":
        return below + 1
    if kind == "dense_rank":
        return F.count_distinct(F.when(value < at, value)) + 1
    if kind == "percent_rank":
        return F.when(n > 0, below / n).otherwise(0.0)
    return (F.count_if(value <= at) + 1) / (n + 1)


def enum_min(label: Column, labels: list[str]) -> Column:
    """The label that stands first in the declared order."""
    return F.min_by(label, F.array_position(F.array(*map(F.lit, labels)), label))


def fold_aggregate(df: DataFrame, keys: list[str], value: Column, order: list[Column], start: Column, step: Callable, finish: Callable, name: str) -> DataFrame:
    """A user-defined aggregate: values of each group in order, folded by expressions."""
    held = F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))))
    return df.groupBy(*keys).agg(F.aggregate(held, start, lambda acc, x: step(acc, x.v), finish).alias(name))


R.sql("A1_plain", f"SELECT count(*) AS n, {MONEY.format('l_quantity')} AS q, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
R.sql("A1_hashed", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_extendedprice')} AS p FROM lineitem GROUP BY l_returnflag, l_linestatus")
R.sql("A2_group", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
R.sql("A3_partial_final", "SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey")
R.sql("A4_rollup", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_quantity')} AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
R.sql("A4_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql(
    "A4_grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g1, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS g, count(*) AS n
       FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
R.sql("A5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
R.sql("A5_having_no_group", "SELECT count(*) AS n FROM orders HAVING max(o_totalprice) > 10")
R.sql("A6_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
R.sql("A7_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql(
    "A8_ordered",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
)
R.sql(
    "A9_ordered_set",
    """SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_nationkey) AS med, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY c_nationkey) AS INT) AS q1
       FROM customer GROUP BY c_mktsegment""",
)
R.sql("A9_mode", "SELECT n_regionkey, mode() WITHIN GROUP (ORDER BY n_regionkey) AS m FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, mode(n_regionkey) AS m FROM nation GROUP BY n_regionkey")
R.sql("A11_min_max", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
R.sql("A12_basic", "SELECT count(*) AS n, count(c_acctbal) AS nb, min(c_name) AS a, max(c_name) AS z, round(avg(CAST(c_nationkey AS DOUBLE)), 9) AS m FROM customer")
R.sql(
    "A13_statistics",
    """SELECT round(stddev_samp(c_nationkey), 8) AS a, round(stddev_pop(c_nationkey), 8) AS b, round(var_samp(c_nationkey), 8) AS c, round(var_pop(c_nationkey), 8) AS d,
       round(corr(c_nationkey, c_custkey), 8) AS e, round(covar_pop(c_nationkey, c_custkey), 6) AS f, round(covar_samp(c_nationkey, c_custkey), 6) AS g FROM customer""",
)
R.sql(
    "A13_regression",
    """SELECT CAST(regr_count(p_size, p_partkey) AS BIGINT) AS n, round(regr_slope(p_size, p_partkey), 8) AS s, round(regr_intercept(p_size, p_partkey), 6) AS i,
       round(regr_r2(p_size, p_partkey), 8) AS r, round(regr_avgx(p_size, p_partkey), 6) AS ax, round(regr_avgy(p_size, p_partkey), 6) AS ay,
       round(regr_sxx(p_size, p_partkey), 3) AS xx, round(regr_syy(p_size, p_partkey), 3) AS yy, round(regr_sxy(p_size, p_partkey), 3) AS xy
       FROM (SELECT CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS DOUBLE) AS p_partkey FROM part) t""",
)
R.sql("A14_bits", "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx FROM nation GROUP BY n_regionkey")
R.sql(
    "A16_json_agg",
    "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey",
)
R.sql(
    "A18_range_union",
    "SELECT o_orderstatus, min(lo) AS lo, max(hi) AS hi FROM (SELECT o_orderstatus, o_orderdate AS lo, o_orderdate + INTERVAL 3 DAYS AS hi FROM orders) t GROUP BY o_orderstatus",
)
R.sql("A20_approx_distinct", "SELECT approx_count_distinct(o_custkey) AS n FROM orders", None)


@R.frame(
    "A10_hypothetical",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 100000) + 1 AS r, count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 100000) + 1 AS d,
       round(count(*) FILTER (WHERE o_totalprice < 100000) / count(*), 9) AS p, round((count(*) FILTER (WHERE o_totalprice <= 100000) + 1) / (count(*) + 1), 9) AS c
       FROM orders GROUP BY o_orderstatus""",
)
def _hypothetical(t):
    x, v = F.col("o_totalprice"), F.lit(100000.0)
    kinds = {"r": "rank", "d": "dense_rank"}
    rounded = {"p": "percent_rank", "c": "cume_dist"}
    return t.orders.groupBy("o_orderstatus").agg(
        *(hypothetical(x, v, k).alias(n) for n, k in kinds.items()), *(F.round(hypothetical(x, v, k), 9).alias(n) for n, k in rounded.items())
    )


@R.frame(
    "A15_array_agg",
    """SELECT n_regionkey, array_to_string(list_transform(list(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END ORDER BY n_nationkey), lambda x: coalesce(CAST(x AS VARCHAR), '?')), ',') AS a
       FROM nation GROUP BY n_regionkey""",
)
def _array_agg(t):
    value = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))
    held = t.nation.groupBy("n_regionkey").agg(array_agg_nulls(value, F.col("n_nationkey")).alias("a"))
    return held.select("n_regionkey", F.array_join(F.transform("a", lambda x: x.cast("string")), ",", "?").alias("a"))


@R.frame("A17_enum_min", "SELECT c_nationkey, min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def _enum(t):
    order = ["P", "O", "F"]
    got = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(enum_min(F.col("o_orderstatus"), order).alias("s"))
    return got.select("c_nationkey", F.array_position(F.array(*map(F.lit, order)), F.col("s")).cast("int").alias("k"))


@R.frame(
    "A19_int_array",
    "SELECT n_regionkey, len(list(n_nationkey)) AS n, CAST(list_sum(list(n_nationkey)) AS BIGINT) AS s FROM nation GROUP BY n_regionkey",
)
def _int_array(t):
    held = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("a"))
    return held.select("n_regionkey", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("s"))


@R.frame("A21_user_aggregate", "SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS sq FROM nation GROUP BY n_regionkey")
def _user(t):
    key = F.col("n_nationkey").cast("long")
    return fold_aggregate(t.nation, ["n_regionkey"], key, [key], F.lit(0).cast("long"), lambda acc, v: acc + v * v, lambda acc: acc, "sq")
