"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.base import Registry
from ..sources import io
from .sampling import bernoulli, system, system_rows

R = Registry()
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
TICKET = (
    "(((({0} % 4294967296 + 4294967296) % 4294967296 + {1}) % 4294967296) % 65536 * 2654435761 "
    "+ ((({0} % 4294967296 + 4294967296) % 4294967296 + {1}) % 4294967296) // 65536 * 40503) % 4294967296"
)

R.sql("SC1_seq_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
R.sql("SC3_range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300")
R.sql("SC4_pruned_scan", f"SELECT l_returnflag, {MONEY.format('l_quantity')} AS q FROM lineitem GROUP BY l_returnflag")
R.sql("SC5_equality_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
R.sql("SC6_and_or_scan", "SELECT p_partkey FROM part WHERE (p_size = 10 AND p_retailprice > 1000) OR (p_size = 20 AND p_brand = 'Brand#13')")
R.sql("SC7_in_list_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (1, 17, 42, 101)")
R.sql("SC9_subquery_scan", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 12")
R.sql(
    "SC10_function_scan",
    "SELECT c_custkey, CAST(pos + 1 AS INT) AS ord, col AS word FROM customer LATERAL VIEW posexplode(split(c_name, '#')) AS pos, col",
    "SELECT c_custkey, CAST(generate_subscripts(w, 1) AS INT) AS ord, unnest(w) AS word FROM (SELECT c_custkey, string_split(c_name, '#') AS w FROM customer)",
)
R.sql("SC11_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
R.sql(
    "SC12_xml_table",
    """SELECT p_partkey, inline(arrays_zip(xpath(x, '/r/i/text()') AS item, xpath(x, '/r/i/@n') AS n))
       FROM (SELECT p_partkey, concat('<r><i n="1">', p_brand, '</i><i n="2">', p_size, '</i></r>') AS x FROM part)""".replace(
        "arrays_zip(xpath(x, '/r/i/text()') AS item, xpath(x, '/r/i/@n') AS n)",
        "transform(arrays_zip(xpath(x, '/r/i/text()'), xpath(x, '/r/i/@n')), z -> named_struct('item', z['0'], 'n', z['1']))",
    ),
    "SELECT p_partkey, p_brand AS item, '1' AS n FROM part UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR), '2' FROM part",
)
R.sql(
    "SC13_shared_cte",
    "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN (SELECT max(n) AS m FROM t) b ON a.n = b.m",
)
R.sql("SC18_result", "SELECT 1 + 1 AS two, 'x' AS x")
R.sql("SC19_series", "SELECT explode(sequence(1, 100, 7)) AS i", "SELECT CAST(unnest(generate_series(1, 100, 7)) AS INT) AS i")


@R.frame("SC2_sample", None)
def _sample(t):
    return t.lineitem.sample(0.1, seed=42).select("l_orderkey", "l_linenumber")


@R.frame("SC2a_bernoulli", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {TICKET.format('(l_orderkey * 8 + l_linenumber)', 7)} < {int(0.1 * 2**32)}")
def _bernoulli(t):
    return bernoulli(t.lineitem, F.col("l_orderkey") * 8 + F.col("l_linenumber"), 10, 7).select("l_orderkey", "l_linenumber")


@R.frame("SC2b_system", f"SELECT o_orderkey FROM orders WHERE {TICKET.format('(o_orderkey // 128)', 3)} < {int(0.25 * 2**32)}")
def _system(t):
    return system(t.orders, F.col("o_orderkey"), 25, 128, 3).select("o_orderkey")


@R.frame("SC2c_system_rows", f"SELECT o_orderkey FROM orders ORDER BY {TICKET.format('o_orderkey', 5)}, o_orderkey LIMIT 100")
def _system_rows(t):
    return system_rows(t.orders, F.col("o_orderkey"), 100, 5).select("o_orderkey")


@R.frame("SC16a_csv_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 1")
def _csv(t):
    path = io.fresh_path(t.spark, "csv")
    io.copy_to(t.nation, path, "csv", header=True)
    return io.copy_from(t.spark, path, "n_nationkey int, n_name string, n_regionkey int", "csv", header=True, where="n_regionkey > 1")


@R.frame("SK1_copy_from", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer WHERE c_custkey > 10")
def _copy_from(t):
    path = io.fresh_path(t.spark, "text")
    io.copy_to(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name")), path)
    return io.copy_from(t.spark, path, "c_custkey long, name string", where="c_custkey > 10")


@R.frame("SK2_copy_to", "SELECT r_regionkey, r_name FROM region")
def _copy_to(t):
    path = io.fresh_path(t.spark, "orc")
    t.region.write.orc(path)
    return t.spark.read.orc(path)


@R.frame("SK3_create_table_as", f"SELECT o_orderstatus, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus")
def _ctas(t):
    made = io.create_table_as(
        t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")),
        io.fresh_path(t.spark, "ctas"), partition_by=("o_orderstatus",),
    )
    return made.select("o_orderstatus", "n", "total")


@R.frame("SK4_materialized_view", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _view(t):
    view = io.MaterializedView(t.spark, "view", lambda: t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n")))
    view.refresh()
    return view.read()


@R.frame(
    "SK5_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders
       UNION ALL SELECT o_orderkey + 10000000, 'Z' FROM orders WHERE o_orderkey % 5 = 0""",
)
def _upsert(t):
    target = t.orders.select("o_orderkey", "o_orderstatus")
    changed = target.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"))
    return io.upsert(target, changed.unionAll(changed.withColumn("o_orderkey", F.col("o_orderkey") + 10000000)), ["o_orderkey"])


@R.frame("SK5_delete_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_nationkey = 3)")
def _delete_update(t):
    kept = io.delete_rows(t.customer, F.col("c_nationkey") == 3)
    return io.update_rows(kept, F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0)).select("c_custkey", "c_acctbal")


@R.frame("SK8_explain", None)
def _explain(t):
    df = t.lineitem.where("l_orderkey < 10").select("l_orderkey")
    text = df._jdf.queryExecution().explainString(t.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return t.spark.createDataFrame([(line,) for line in text.split("\n")], "line string")
