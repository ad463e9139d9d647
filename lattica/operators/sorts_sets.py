"""Sorts, limits, top-k, distinct, set operations, recursion, pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.base import Registry
from ..sources import io

R = Registry()


def asc(column: str) -> Column:
    """Ascending with nulls last: nulls count as largest."""
    return F.col(column).asc_nulls_last()


def desc(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 1000) -> DataFrame:
    """Base rows, then what ``step`` makes of the rows of the last round, until a round adds none.

    Each round is written to the shared folder, so that plans stay short and a
    lost executor repeats one round at most.
    """
    spark = base.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = io.fresh_path(spark, "round")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    fresh = kept(base.distinct() if distinct else base)
    rounds = [fresh]
    for _ in range(most):
        made = step(fresh).select(*base.columns)
        if distinct:
            known = rounds[0]
            for r in rounds[1:]:
                known = known.unionAll(r)
            made = made.distinct().exceptAll(known.distinct()) if len(rounds) > 1 else made.distinct().subtract(known)
        fresh = kept(made)
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    else:
        raise RecursionError(f"more than {most} rounds")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionAll(r)
    return out


def connect_by(df: DataFrame, key: str, parent: str, start, depth: int = 0, sep: str = "~") -> DataFrame:
    """(key, parent, level, branch) of the tree under ``start``; raises where a row would be its own ancestor."""
    edges = df.select(F.col(key).alias("_k"), F.col(parent).alias("_p"))
    kind = df.schema[key].dataType
    base = df.sparkSession.range(1).select(
        F.lit(start).cast(kind).alias(key), F.lit(None).cast(kind).alias(parent), F.lit(0).alias("level"), F.array(F.lit(start).cast(kind)).alias("branch")
    )

    def step(rows: DataFrame) -> DataFrame:
        if depth:
            rows = rows.where(F.col("level") < depth)
        nxt = rows.join(edges, F.col(key) == F.col("_p"))
        looped = F.array_contains("branch", F.col("_k"))
        key_ = F.when(looped, F.raise_error(F.lit("infinite recursion detected")).cast(kind)).otherwise(F.col("_k"))
        return nxt.select(key_.alias(key), F.col("_p").alias(parent), (F.col("level") + 1).alias("level"), F.concat("branch", F.array("_k")).alias("branch"))

    found = recursive_union(base, step, distinct=False)
    return found.select(key, parent, "level", F.array_join(F.transform("branch", lambda x: x.cast("string")), sep).alias("branch"))


R.sql("O1_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey NULLS LAST")
R.sql("O2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("O3_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 35")
R.sql("O4_unique", "SELECT DISTINCT l_shipdate FROM lineitem")
R.sql("O6_merge_append", "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey AS k FROM supplier) t ORDER BY k")
R.sql("O7_material", "WITH m AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.k, a.n + b.n AS n FROM m a JOIN m b ON a.k = b.k")
R.sql("O9_collate", "SELECT n_name FROM nation WHERE n_name COLLATE UTF8_LCASE >= 'm'", "SELECT n_name FROM nation WHERE lower(n_name) >= 'm'")
R.sql("SO1_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
R.sql("SO2_union", "SELECT n_regionkey AS k FROM nation UNION SELECT s_nationkey AS k FROM supplier")
R.sql("SO3_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
R.sql("SO3_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
R.sql("SO4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
R.sql("SO4_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
R.sql("SO5_type_union", "SELECT CAST(x AS DOUBLE) AS x FROM (SELECT 1 AS x UNION ALL SELECT 2.5 AS x UNION ALL SELECT CAST(3 AS BIGINT) AS x) t")
R.sql(
    "SO6_recursive_all",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
)
R.sql(
    "SO8_crosstab",
    "SELECT * FROM (SELECT l_returnflag, l_linestatus, 1 AS x FROM lineitem) PIVOT (count(x) FOR l_linestatus IN ('F' AS f, 'O' AS o))",
    "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY l_returnflag",
)


@R.frame("O5_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _distinct_on(t):
    return distinct_on(t.orders, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@R.frame("O8_gather", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _gather(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).coalesce(1)


@R.frame("O10_cluster", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 4")
def _cluster(t):
    made = io.create_table_as(t.customer.select("c_custkey", "c_nationkey"), io.fresh_path(t.spark, "clustered"), cluster_by=("c_nationkey",))
    return made.where("c_nationkey = 4")


@R.frame(
    "SO6_recursive_union",
    """WITH RECURSIVE t(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT CASE WHEN i = 0 THEN k * 2 ELSE k * 3 END FROM t, (VALUES (0), (1)) AS v(i) WHERE k < 200)
       SELECT k FROM t""",
)
def _recursive(t):
    base = t.spark.range(1, 2).select(F.col("id").alias("k"))
    return recursive_union(base, lambda r: r.where("k < 200").select(F.explode(F.array(F.col("k") * 2, F.col("k") * 3)).alias("k")))


@R.frame(
    "SO7_connect_by",
    """WITH RECURSIVE t(k, p, level, branch) AS (SELECT CAST(1 AS BIGINT), CAST(NULL AS BIGINT), 0, '1' UNION ALL
       SELECT p_partkey, p_partkey // 3, level + 1, branch || '~' || p_partkey FROM t JOIN part ON p_partkey // 3 = t.k WHERE level < 4)
       SELECT k, p, level, branch FROM t""",
)
def _connect_by(t):
    tree = t.part.select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 3).alias("p"))
    return connect_by(tree, "k", "p", 1, 4)


@R.frame("SO9_normal_rand", None)
def _normal(t):
    return t.spark.range(1000).select(F.randn(42).alias("x"))
