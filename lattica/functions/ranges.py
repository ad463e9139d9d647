"""Range types: struct(lo, hi, lo_inc, hi_inc, empty); a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()


def make(lo: Column, hi: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """discrete: integers and dates, whose ranges are kept as [lo, hi)."""
    if discrete:
        lo = lo if bounds[0] == "[" else lo + 1
        hi = hi + 1 if bounds[1] == "]" else hi
        bounds = "[)"
    li, hi_ = bounds[0] == "[", bounds[1] == "]"
    wrong = F.coalesce(lo > hi, F.lit(False))
    hi = F.when(wrong, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("int").isNull().cast("int")).otherwise(hi) if not discrete else hi
    none = F.coalesce((lo > hi) | ((lo == hi) & F.lit(not (li and hi_))), F.lit(False))
    return _struct(lo, hi, F.lit(li) & lo.isNotNull(), F.lit(hi_) & hi.isNotNull(), none)


def _struct(lo, hi, li, hi_inc, empty) -> Column:
    return F.struct(
        F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (li & ~empty).alias("lo_inc"), (hi_inc & ~empty).alias("hi_inc"), empty.alias("empty")
    )


def is_empty(r: Column) -> Column:
    return r["empty"]


def lower_inf(r: Column) -> Column:
    return r["lo"].isNull() & ~r["empty"]


def upper_inf(r: Column) -> Column:
    return r["hi"].isNull() & ~r["empty"]


def has(r: Column, x: Column) -> Column:
    """Range contains element."""
    above = r["lo"].isNull() | (x > r["lo"]) | (r["lo_inc"] & (x == r["lo"]))
    below = r["hi"].isNull() | (x < r["hi"]) | (r["hi_inc"] & (x == r["hi"]))
    return ~r["empty"] & above & below


def _starts_no_later(a: Column, b: Column) -> Column:
    return F.when(a["lo"].isNull(), True).when(b["lo"].isNull(), False).otherwise((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])))


def _ends_no_sooner(a: Column, b: Column) -> Column:
    return F.when(a["hi"].isNull(), True).when(b["hi"].isNull(), False).otherwise((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"])))


def contains(a: Column, b: Column) -> Column:
    return F.when(b["empty"], True).when(a["empty"], False).otherwise(_starts_no_later(a, b) & _ends_no_sooner(a, b))


def left_of(a: Column, b: Column) -> Column:
    before = F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))
    return ~a["empty"] & ~b["empty"] & before


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~left_of(a, b) & ~left_of(b, a)


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def not_right_of(a: Column, b: Column) -> Column:
    """a does not extend to the right of b."""
    return ~a["empty"] & ~b["empty"] & _ends_no_sooner(b, a)


def not_left_of(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _starts_no_later(b, a)


def intersection(a: Column, b: Column) -> Column:
    first, last = _starts_no_later(a, b), _ends_no_sooner(a, b)
    pick = lambda c, x, y, f: F.when(c, x[f]).otherwise(y[f])
    return _struct(pick(first, b, a, "lo"), pick(last, b, a, "hi"), pick(first, b, a, "lo_inc"), pick(last, b, a, "hi_inc"), ~overlaps(a, b))


def merge(a: Column, b: Column) -> Column:
    """The smallest range that holds both."""
    first, last = _starts_no_later(a, b), _ends_no_sooner(a, b)
    pick = lambda c, f: F.when(c, a[f]).otherwise(b[f])
    both = _struct(pick(first, "lo"), pick(last, "hi"), pick(first, "lo_inc"), pick(last, "hi_inc"), F.lit(False))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def union(a: Column, b: Column) -> Column:
    apart = ~a["empty"] & ~b["empty"] & ~overlaps(a, b) & ~adjacent(a, b)
    checked = F.when(apart, F.raise_error(F.lit("result of range union would not be contiguous")).cast("boolean")).otherwise(F.lit(False))
    m = merge(a, b)
    return F.when(~checked, m)


def difference(a: Column, b: Column) -> Column:
    first, last = _starts_no_later(a, b), _ends_no_sooner(a, b)
    inside = overlaps(a, b) & first & last & ~(_starts_no_later(b, a)) & ~(_ends_no_sooner(b, a))
    checked = F.when(inside, F.raise_error(F.lit("result of range difference would not be contiguous")).cast("boolean")).otherwise(F.lit(False))
    keep_left = _struct(a["lo"], b["lo"], a["lo_inc"], ~b["lo_inc"], F.lit(False))
    keep_right = _struct(b["hi"], a["hi"], ~b["hi_inc"], a["hi_inc"], F.lit(False))
    nothing = _struct(a["lo"], a["hi"], a["lo_inc"], a["hi_inc"], F.lit(True))
    return F.when(checked, a).when(~overlaps(a, b), a).when(contains(b, a), nothing).when(first & ~_starts_no_later(b, a), keep_left).otherwise(keep_right)


def order_key(r: Column) -> Column:
    """Empty ranges first, then by lower and upper bound."""
    return F.struct((~r["empty"]).alias("a"), r["lo"].isNotNull().alias("b"), r["lo"].alias("c"), (~r["lo_inc"]).alias("d"), r["hi"].isNull().alias("e"), r["hi"].alias("f"), r["hi_inc"].alias("g"))


def to_text(r: Column) -> Column:
    body = F.concat(
        F.when(r["lo_inc"], "[").otherwise("("), F.coalesce(r["lo"].cast("string"), F.lit("")), F.lit(","),
        F.coalesce(r["hi"].cast("string"), F.lit("")), F.when(r["hi_inc"], "]").otherwise(")"),
    )
    return F.when(r["empty"], "empty").otherwise(body)


_A, _B = "n_nationkey", "(n_nationkey + 5)"


@R.frame(
    "F_range_operators",
    """SELECT n_nationkey AS k, 7 >= n_nationkey AND 7 < n_nationkey + 5 AS h, n_nationkey >= 5 AND n_nationkey + 5 <= 16 AS c, n_nationkey < 16 AND 5 < n_nationkey + 5 AS o,
       n_nationkey + 5 <= 5 AS l, 16 <= n_nationkey AS r, n_nationkey + 5 = 5 OR n_nationkey = 16 AS a, n_nationkey + 5 <= 16 AS nr, n_nationkey >= 5 AS nl FROM nation""",
)
def _operators(t):
    k = F.col("n_nationkey")
    a, b = make(k, k + 5, discrete=True), make(F.lit(5), F.lit(15), "[]", discrete=True)
    return t.nation.select(k.alias("k"), a.alias("a"), b.alias("b")).select(
        "k", has(F.col("a"), F.lit(7)).alias("h"), contains(F.col("b"), F.col("a")).alias("c"), overlaps(F.col("a"), F.col("b")).alias("o"),
        left_of(F.col("a"), F.col("b")).alias("l"), left_of(F.col("b"), F.col("a")).alias("r"), adjacent(F.col("a"), F.col("b")).alias("adj"),
        not_right_of(F.col("a"), F.col("b")).alias("nr"), not_left_of(F.col("a"), F.col("b")).alias("nl"),
    ).withColumnRenamed("adj", "a")


@R.frame(
    "F_range_sets",
    """SELECT n_nationkey AS k, CASE WHEN n_nationkey < 16 AND 5 < n_nationkey + 5 THEN '[' || greatest(n_nationkey, 5) || ',' || least(n_nationkey + 5, 16) || ')' ELSE 'empty' END AS i,
       '[' || least(n_nationkey, 5) || ',' || greatest(n_nationkey + 5, 16) || ')' AS m FROM nation""",
)
def _sets(t):
    k = F.col("n_nationkey")
    rows = t.nation.select(k.alias("k"), make(k, k + 5, discrete=True).alias("a"), make(F.lit(5), F.lit(16), discrete=True).alias("b"))
    return rows.select("k", to_text(intersection(F.col("a"), F.col("b"))).alias("i"), to_text(merge(F.col("a"), F.col("b"))).alias("m"))
