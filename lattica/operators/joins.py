"""Joins: all types, and range, as-of and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joinorder.apply import drop_useless_outer_join, join_all
from ..joinorder.stats import Input
from ..plans.base import Registry

R = Registry()
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def range_join(left: DataFrame, right: DataFrame, low: str, high: str, low2: str, high2: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs whose half-open intervals [low, high) and [low2, high2) overlap (and whose keys are equal).

    Both sides are laid out over bins of ``width`` and joined on the bin; a pair
    counts only in the bin where the later of the two begins, so none is repeated.
    Unbounded intervals must be clamped first.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.greatest(F.floor(F.col(a) / width), F.ceil(F.col(b) / width) - 1)))
    a = left.where(F.col(low) < F.col(high)).withColumn("_bin", bins(low, high))
    b = right.where(F.col(low2) < F.col(high2)).withColumn("_bin", bins(low2, high2))
    both = a.join(b, ["_bin", *(keys or [])])
    overlap = (F.col(low) < F.col(high2)) & (F.col(low2) < F.col(high))
    first = F.col("_bin") == F.floor(F.greatest(F.col(low), F.col(low2)) / width)
    return both.where(overlap & first).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str, keys: list[str], values: list[str], slices: Column | None = None) -> DataFrame:
    """For each left row the values of the last right row of the same keys that is not later.

    The two sides are united and sorted once for each key; no pairs are made.
    """
    marker = F.struct(F.col(right_on).alias("_at"), *values)
    a = left.select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(marker.alias("m")).schema["m"].dataType).alias("_m"))
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), marker.alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    united = a.unionByName(b).withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    return united.select("_row.*", F.col("_m._at").alias(right_on), *(F.col(f"_m.{v}").alias(v) for v in values))


def nearest(points: DataFrame, distance: Column, k: int, per: list[str], tie: str) -> DataFrame:
    """The k rows of least distance for each group, nulls last; Spark limits them before its exchange."""
    w = Window.partitionBy(*per).orderBy(distance.asc_nulls_last(), F.col(tie).asc_nulls_last())
    return points.withColumn("_d", distance).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def nearest_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], values: tuple[str, str], k: int, per: str, tie: str) -> DataFrame:
    """(per, tie) of the k right rows of an equal key whose value is nearest, for each ``per`` of the left rows.

    Ties go to the smaller ``tie``; distances that are null come last, NaN before them.
    Of right rows with one key and value only the k least ties count.  The distinct
    values of a key are numbered in order, each left row finds its place among them, and
    only the k places on either side and one more are joined.  Values that are null or
    not finite are all equally far, so that k of each kind are joined to every left row.
    Where rounding makes the place beyond as near as a row that was taken, that ``per``
    is compared with all rows of its keys.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    least = lambda *by: F.row_number().over(Window.partitionBy("_key", *by).orderBy(F.col("_tie").asc_nulls_last()))
    a = left.select(F.col(per).alias("_per"), F.col(keys[0]).alias("_key"), F.col(values[0]).alias("_s")).where("_key is not null")
    b = right.select(F.col(keys[1]).alias("_key"), F.col(values[1]).alias("_v"), F.col(tie).alias("_tie")).where("_key is not null")
    held = b.where(finite("_v")).withColumn("_n", least("_v")).where(F.col("_n") <= k)
    held = held.withColumn("_place", F.dense_rank().over(Window.partitionBy("_key").orderBy("_v")))
    placed = asof_join(a.where(finite("_s")), held.where("_n = 1").select("_key", "_v", "_place"), "_s", "_v", ["_key"], ["_place"])
    steps = placed.select("_per", "_key", "_s", F.coalesce("_place", F.lit(0)).alias("_from"), F.explode(F.sequence(F.lit(-k), F.lit(k + 1))).alias("_step"))
    steps = steps.withColumn("_place", F.col("_from") + F.col("_step"))
    distance = F.abs(F.col("_s") - F.col("_v")).alias("_d")
    beyond = F.col("_step").isin(-k, k + 1).alias("_beyond")
    near = steps.join(held.select("_key", "_place", "_v", "_tie"), ["_key", "_place"]).select("_per", "_tie", distance, beyond)
    kind = F.when(finite("_v"), "finite").otherwise(F.col("_v").cast("string"))
    kinds = b.withColumn("_kind", kind).withColumn("_n", least("_kind")).where(F.col("_n") <= k)
    far = a.join(kinds, "_key").where(~(finite("_s") & finite("_v"))).select("_per", "_tie", distance, F.lit(False).alias("_beyond"))
    w = Window.partitionBy("_per")
    ranked = near.unionAll(far).withColumn("_rank", F.row_number().over(w.orderBy(F.col("_d").asc_nulls_last(), F.col("_tie").asc_nulls_last())))
    last = F.max(F.when(F.col("_rank") <= k, F.col("_d"))).over(w)
    ranked = ranked.withColumn("_open", F.coalesce(F.min(F.when(F.col("_beyond"), F.col("_d"))).over(w) <= last, F.lit(False)))
    open_ = ranked.where("_open").select(F.col("_per").alias("_of")).distinct()
    rest = a.join(open_, F.col("_per").eqNullSafe(F.col("_of")), "left_semi").join(b, "_key")
    rest = nearest(rest, F.abs(F.col("_s") - F.col("_v")), k, ["_per"], "_tie").select("_per", "_tie")
    both = ranked.where(~F.col("_open") & (F.col("_rank") <= k)).select("_per", "_tie").unionAll(rest)
    return both.select(F.col("_per").alias(per), F.col("_tie").alias(tie))


R.sql("J1_hash_join", f"SELECT /*+ SHUFFLE_HASH(o) */ o_orderstatus, count(*) AS n, {MONEY.format('l_quantity')} AS q FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
R.sql("J2_merge_join", f"SELECT /*+ MERGE(o) */ o_orderpriority, count(*) AS n, {MONEY.format('l_tax')} AS q FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
R.sql("J3_nested_loop", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey * 5 < n_nationkey")
R.sql("J3_theta_left", "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey > n_nationkey")
R.sql("J4_lookup_join", "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer JOIN nation n ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
R.sql("J5_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000")
R.sql("J5_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000")
R.sql("J6_full", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_suppkey + 10")
R.sql("J7_semi", "SELECT s_suppkey FROM supplier LEFT SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49", "SELECT s_suppkey FROM supplier SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49")
R.sql("J8_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
R.sql("J9_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
R.sql("J10_using", "SELECT k, r_name, n FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) b USING (k)")
R.sql("J10_natural", "SELECT k, r_name, n FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) b")
R.sql("J14_equivalence", "SELECT count(*) AS n FROM customer, nation, supplier WHERE c_nationkey = n_nationkey AND n_nationkey = s_nationkey AND s_nationkey = 5")
R.sql("J16_partition_wise", f"SELECT o_orderkey, {MONEY.format('l_quantity')} AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) > 6")


@R.frame(
    "J11_range_join",
    """SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, epoch(ts) AS s FROM events WHERE event_type = 'error') a
       JOIN (SELECT *, epoch(ts) AS s FROM events WHERE event_type = 'signup') b ON a.s < b.s + 1800 AND b.s < a.s + 900""",
)
def _range(t):
    spans = t.events.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = F.col("us") / 1e6
    a = spans.where("event_type = 'error'").select(F.col("event_id").alias("a"), s.alias("lo"), (s + 900).alias("hi"))
    b = spans.where("event_type = 'signup'").select(F.col("event_id").alias("b"), s.alias("lo2"), (s + 1800).alias("hi2"))
    return range_join(a, b, "lo", "hi", "lo2", "hi2", 1800.0).select("a", "b")


@R.frame(
    "J12_asof_join",
    """SELECT a.event_id, b.v AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a
       ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b
       ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def _asof(t):
    views = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("value").alias("last_view"))
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, "ts", "vts", ["user_id"], ["last_view"]).select("event_id", "last_view")


@R.frame(
    "J13_nearest",
    """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r
       FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE r <= 3""",
)
def _nearest(t):
    return nearest_join(t.supplier, t.customer, ("s_nationkey", "c_nationkey"), ("s_acctbal", "c_acctbal"), 3, "s_suppkey", "c_custkey")


@R.frame("J15_join_removal", "SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _removed(t):
    return drop_useless_outer_join(t.orders, t.customer, ("o_custkey", "c_custkey"), ["o_orderkey", "o_custkey"], True)


@R.frame(
    "J17_many_way",
    f"""SELECT n_name, p_brand, count(*) AS n, {MONEY.format('l_quantity')} AS q FROM lineitem, orders, customer, nation, region, part
        WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
        AND l_partkey = p_partkey AND p_size < 10 GROUP BY n_name, p_brand""",
)
def _many(t):
    inputs = [
        Input("lineitem", t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), references={"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey")}),
        Input("orders", t.orders.select("o_orderkey", "o_custkey"), unique=("o_orderkey",), references={"o_custkey": ("customer", "c_custkey")}),
        Input("customer", t.customer.select("c_custkey", "c_nationkey"), unique=("c_custkey",), references={"c_nationkey": ("nation", "n_nationkey")}),
        Input("nation", t.nation, unique=("n_nationkey",), references={"n_regionkey": ("region", "r_regionkey")}),
        Input("region", t.region, unique=("r_regionkey",)),
        Input("part", t.part.select("p_partkey", "p_brand", "p_size"), F.col("p_size") < 10, unique=("p_partkey",)),
    ]
    on = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
    ]
    joined = join_all(inputs, on)
    return joined.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))


FLAGSHIP = f"""SELECT n_name, {MONEY.format('l_extendedprice * (1 - l_discount)')} AS revenue
    FROM lineitem, orders, customer, supplier, nation, region
    WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = n_nationkey
    AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name"""


def flagship(t, algorithm: str | None = "greedy") -> DataFrame:
    """Revenue by nation of customers and suppliers at home: a six-way join with a class of three members."""
    inputs = [
        Input("lineitem", t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), references={"l_orderkey": ("orders", "o_orderkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        Input("orders", t.orders.select("o_orderkey", "o_custkey"), unique=("o_orderkey",), references={"o_custkey": ("customer", "c_custkey")}),
        Input("customer", t.customer.select("c_custkey", "c_nationkey"), unique=("c_custkey",), references={"c_nationkey": ("nation", "n_nationkey")}),
        Input("supplier", t.supplier.select("s_suppkey", "s_nationkey"), unique=("s_suppkey",), references={"s_nationkey": ("nation", "n_nationkey")}),
        Input("nation", t.nation, unique=("n_nationkey",), references={"n_regionkey": ("region", "r_regionkey")}),
        Input("region", t.region, unique=("r_regionkey",)),
    ]
    on = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ]
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,2)")
    return join_all(inputs, on, algorithm).groupBy("n_name").agg(F.sum(price).cast("double").alias("revenue"))


R.frame("joinorder_flagship", FLAGSHIP)(flagship)
for _name in ("by_size", "by_subset", "by_block", "by_pairs", "ranked", "linearized", "adaptive", "bottom_up", "iterated", "partitioned", "cut", "genetic"):
    R.frame(f"joinorder_{_name}", FLAGSHIP)(lambda t, a=_name: flagship(t, a))
