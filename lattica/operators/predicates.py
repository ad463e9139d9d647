"""Projection, filters, predicates and subqueries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()


def row_less(left: list[Column], right: list[Column], or_equal: bool = False) -> Column:
    """Row-wise comparison, null as soon as a deciding pair holds a null."""
    out = (left[-1] <= right[-1]) if or_equal else (left[-1] < right[-1])
    for a, b in list(zip(left, right))[-2::-1]:
        out = (a < b) | ((a == b) & out)
    return out


def num_nulls(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.isNull().cast("int") for c in columns))


def num_nonnulls(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))


def similar_to_regex(pattern: str, escape: str = "\\") -> str:
    """The Java regular expression of a SIMILAR TO pattern (whole-string match)."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif in_class:
            out.append("\\\\" if c == "\\" else c)
            in_class = c != "]"
        elif c == "[":
            out.append(c)
            in_class = True
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "(":
            out.append("(?:")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


R.sql("PR1_projection", "SELECT l_orderkey + l_partkey AS s, l_quantity * 2 AS q2, l_linenumber FROM lineitem")
R.sql(
    "PR2_lockstep_sets",
    """SELECT r_regionkey, z['0'] AS a, z['1'] AS b FROM region
       LATERAL VIEW explode(arrays_zip(sequence(1, 3), slice(array(10, 20), 1, 2))) AS z""",
    "SELECT r_regionkey, unnest([1, 2, 3]) AS a, unnest([10, 20]) AS b FROM region",
)
R.sql("PR3_filter", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
R.sql(
    "PR4_three_valued",
    """SELECT a, b, a AND b AS c, a OR b AS d, NOT a AS e FROM
       (VALUES (true, true), (true, false), (true, NULL), (false, NULL), (NULL, NULL), (false, false)) AS t(a, b)""",
)
R.sql("PR5_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS t(a, b)")
R.sql("PR6_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000 OR o_totalprice NOT BETWEEN 1000 AND 400000")
R.sql(
    "PR7_case",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS c,
              CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 END AS d FROM part""",
)
R.sql("PR8_coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS x, nullif(c_mktsegment, 'BUILDING') AS y FROM customer")
R.sql("PR9_greatest_least", "SELECT greatest(a, b, c) AS g, least(a, b, c) AS l FROM (VALUES (1, 5, NULL), (NULL, NULL, NULL), (3, 2, 1)) AS t(a, b, c)")
R.sql("PR10_like", "SELECT c_name FROM customer WHERE c_name LIKE '%1_' AND c_name NOT LIKE '%9%' OR c_name LIKE 'x!_%' ESCAPE '!'")
R.sql("PR11_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE '%a%'")
R.sql("PR13_regex", "SELECT n_name, n_name RLIKE '^[A-M].*[A-Z0-9]$' AS m FROM nation", "SELECT n_name, regexp_matches(n_name, '^[A-M].*[A-Z0-9]$') AS m FROM nation")
R.sql("PR15_in_subquery", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_acctbal > 9000)")
R.sql("PR15_not_in_nulls", "SELECT a FROM (VALUES (1), (2), (NULL)) AS t(a) WHERE a NOT IN (SELECT b FROM (VALUES (1), (NULL)) AS u(b))")
R.sql("PR16_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
R.sql("PR16_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
R.sql(
    "PR17_any_all",
    """SELECT p_partkey, exists(array(5, 10, 15), x -> p_size = x) AS any_eq, forall(array(5, 10, 15), x -> p_size > x) AS all_gt FROM part
       WHERE p_size > (SELECT min(n_nationkey) FROM nation)""",
    "SELECT p_partkey, p_size = ANY([5, 10, 15]) AS any_eq, p_size > 15 AS all_gt FROM part WHERE p_size > ANY(SELECT n_nationkey FROM nation)",
)
R.sql("PR18_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)")
R.sql(
    "PR18_correlated",
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity >= (SELECT max(m.l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)",
)
R.sql(
    "PR20_lateral",
    "SELECT r_name, t.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation x WHERE x.n_regionkey = r.r_regionkey) t",
)
R.sql(
    "PR21_array_subquery",
    "SELECT array_join(transform(a, x -> CAST(x AS STRING)), ',') AS a FROM (SELECT sort_array((SELECT collect_list(n_nationkey) FROM nation WHERE n_regionkey = 1)) AS a) t",
    "SELECT array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY 1), ',') AS a",
)


@R.frame("PR12_similar_to", "SELECT n_name, regexp_full_match(n_name, '(A|B|N).*[0-9A-Z]_?.') AS m FROM nation")
def _similar(t):
    return t.nation.select("n_name", F.col("n_name").rlike(similar_to_regex("(A|B|N)%[0-9A-Z]\\_?_")).alias("m"))


@R.frame("PR14_row_compare", "SELECT n_nationkey, (n_regionkey, n_nationkey) < (2, 10) AS lt, (n_regionkey, n_nationkey) <= (2, 8) AS le FROM nation")
def _row(t):
    pair = [F.col("n_regionkey"), F.col("n_nationkey")]
    return t.nation.select(
        "n_nationkey", row_less(pair, [F.lit(2), F.lit(10)]).alias("lt"), row_less(pair, [F.lit(2), F.lit(8)], True).alias("le")
    )


@R.frame(
    "PR19_correlated_limit",
    """SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 1) AS k
       FROM customer""",
)
def _nth(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    second = t.orders.withColumn("rn", F.row_number().over(w)).where("rn = 2").select("o_custkey", F.col("o_orderkey").alias("k"))
    return t.customer.join(second, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "k")


@R.frame("PR22_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 4 AND o_totalprice > 1000")
def _prepared(t):
    return t.sql("SELECT o_orderkey FROM orders WHERE o_custkey = :k AND o_totalprice > :p", k=4, p=1000)


@R.frame("PR23_num_nulls", "SELECT n_nationkey, CAST(n_regionkey = 1 AS INT) + CAST(n_nationkey < 5 AS INT) AS z, 3 - CAST(n_regionkey = 1 AS INT) - CAST(n_nationkey < 5 AS INT) AS v FROM nation")
def _nulls(t):
    cols = [F.when(F.col("n_regionkey") != 1, 1), F.when(F.col("n_nationkey") >= 5, 1), F.col("n_name")]
    return t.nation.select("n_nationkey", num_nulls(*cols).alias("z"), num_nonnulls(*cols).alias("v"))
