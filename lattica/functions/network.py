"""Network addresses, hardware addresses, label trees, enums and row identifiers."""

from __future__ import annotations

import ipaddress
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import Registry

R = Registry()


def _of(kind: T.DataType, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(ipaddress.ip_interface(t)))

    return run


host = _of(T.StringType(), lambda i: str(i.ip))
family = _of(T.IntegerType(), lambda i: i.version)
masklen = _of(T.IntegerType(), lambda i: i.network.prefixlen)
network = _of(T.StringType(), lambda i: str(i.network))
netmask = _of(T.StringType(), lambda i: str(i.netmask))
hostmask = _of(T.StringType(), lambda i: str(i.hostmask))
broadcast = _of(T.StringType(), lambda i: f"{i.network.broadcast_address}/{i.network.prefixlen}")


@F.pandas_udf(T.BooleanType())
def inside(a: pd.Series, b: pd.Series) -> pd.Series:
    """a is strictly inside b."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = ipaddress.ip_interface(x).network, ipaddress.ip_interface(y).network
        return x.version == y.version and x.prefixlen > y.prefixlen and x.subnet_of(y)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="boolean")


@F.pandas_udf(T.StringType())
def merged(a: pd.Series, b: pd.Series) -> pd.Series:
    """The smallest network that holds both."""

    def one(x, y):
        x, y = ipaddress.ip_interface(x).network, ipaddress.ip_interface(y).network
        while not y.subnet_of(x):
            x = x.supernet()
        return str(x)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])


def macaddr_trunc(m: Column) -> Column:
    return F.regexp_replace(m, "(?::[0-9a-f]{2}){3}$", ":00:00:00")


def macaddr_not(m: Column) -> Column:
    return F.translate(m, "0123456789abcdef", "fedcba9876543210")


def uuid5(namespace: str):
    space = uuid.UUID(namespace)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else str(uuid.uuid5(space, t)))

    return run


# label trees: labels joined by dots


def nlevel(p: Column) -> Column:
    return F.when(p == "", 0).otherwise(F.size(F.split(p, r"\.")))


def subpath(p: Column, start: int, count: int | None = None) -> Column:
    """Labels from ``start`` (from the end, if negative)."""
    labels = F.split(p, r"\.")
    first = F.lit(start) if start >= 0 else F.size(labels) + start
    n = F.size(labels) - first if count is None else F.lit(count) if count >= 0 else F.size(labels) - first + count
    return F.array_join(F.slice(labels, first + 1, n), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a is b or lies above it."""
    return (a == b) | (a == "") | F.startswith(b, F.concat(a, F.lit(".")))


def lca(a: Column, b: Column) -> Column:
    """The longest common ancestor, above both."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    upto = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)).cast("int") - 1
    most = F.least(F.size(x), F.size(y)) - 1
    return F.array_join(F.slice(x, 1, F.least(upto, most)), ".")


def lquery_regex(query: str) -> str:
    """The regular expression of a label pattern: *, *{n,m}, label|label, !label, label* and label@."""
    out = []
    for i, level in enumerate(query.split(".")):
        m = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", level)
        if m:
            low = m[1] or "0"
            count = f"{{{low},{m[3]}}}" if m[2] or not m[1] else f"{{{low}}}"
            out.append(f"(?:(?:^|\\.)[^.]+){count if level != '*' else '*'}")
            continue
        negated = level.startswith("!")
        words = []
        for word in level.lstrip("!").split("|"):
            flags = "".join(c for c in word if c in "@*%")
            core = re.escape(re.sub(r"[@*%]+$", "", word))
            core = f"(?i:{core})" if "@" in flags else core
            words.append(core + ("[^.]*" if "*" in flags else ""))
        body = "(?:" + "|".join(words) + ")(?=\\.|$)"
        out.append(f"(?:^|\\.)(?!{body})[^.]+" if negated else f"(?:^|\\.){body}")
    return "^" + "".join(out) + "$"


def matches_lquery(p: Column, query: str) -> Column:
    return p.rlike(lquery_regex(query))


# enums: declared order


def enum_position(label: Column, labels: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), label)


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> list[str]:
    return labels[labels.index(first) if first else 0 : labels.index(last) + 1 if last else None]


R.sql("F_session_info", "SELECT typeof(n_nationkey) AS t FROM nation LIMIT 1", None)


@R.frame("F_net_inet", "SELECT n_nationkey AS k, '10.0.' || n_nationkey || '.7' AS h, 4 AS f, 24 AS m, '10.0.' || n_nationkey || '.255/24' AS b, true AS i, n_nationkey = 3 AS j FROM nation")
def _inet(t):
    a = F.concat(F.lit("10.0."), F.col("n_nationkey"), F.lit(".7/24"))
    return t.nation.select(
        F.col("n_nationkey").alias("k"), host(a).alias("h"), family(a).alias("f"), masklen(a).alias("m"), broadcast(a).alias("b"),
        inside(a, F.lit("10.0.0.0/8")).alias("i"), inside(F.concat(F.lit("10.0."), F.col("n_nationkey"), F.lit(".8/32")), F.lit("10.0.3.0/24")).alias("j"),
    )


@R.frame("F_net_macaddr", "SELECT n_nationkey AS k, '08:00:2b:00:00:00' AS t, 'f7:ff:d4:fe:fd:' || lower(lpad(to_hex(255 - n_nationkey), 2, '0')) AS n FROM nation")
def _mac(t):
    m = F.concat(F.lit("08:00:2b:01:02:"), F.lpad(F.lower(F.hex("n_nationkey")), 2, "0"))
    return t.nation.select(F.col("n_nationkey").alias("k"), macaddr_trunc(m).alias("t"), macaddr_not(m).alias("n"))


@R.frame("F_ltree", "SELECT n_nationkey AS k, 3 AS n, 'r' || n_regionkey || '.' || n_name AS s, n_regionkey = 1 AS a, 'top' AS l, n_regionkey IN (1, 2) AS q FROM nation")
def _ltree(t):
    p = F.concat(F.lit("top.r"), F.col("n_regionkey"), F.lit("."), F.col("n_name"))
    return t.nation.select(
        F.col("n_nationkey").alias("k"), nlevel(p).alias("n"), subpath(p, 1).alias("s"), is_ancestor(F.lit("top.r1"), p).alias("a"),
        lca(p, F.lit("top.other.x")).alias("l"), matches_lquery(p, "top.r1|r2.*").alias("q"),
    )


@R.frame("F_enum", "SELECT DISTINCT o_orderstatus AS s, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS o FROM orders")
def _enum(t):
    return t.orders.select(F.col("o_orderstatus").alias("s")).distinct().select("s", enum_position(F.col("s"), ["P", "O", "F"]).cast("int").alias("o"))
