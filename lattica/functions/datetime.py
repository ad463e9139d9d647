"""Dates, timestamps and three-field intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()
DAY_US = 86_400_000_000


def extract(field: str, ts: Column) -> Column:
    """Fields as SQL counts them: Sunday is dow 0 and isodow 7, centuries and millennia start with year 1."""
    year = F.year(ts)
    # years before 1 do not occur
    known = {
        "epoch": lambda: F.unix_micros(ts.cast("timestamp")) / 1e6,
        "century": lambda: F.ceil(year / 100).cast("int"),
        "millennium": lambda: F.ceil(year / 1000).cast("int"),
        "decade": lambda: F.floor(year / 10).cast("int"),
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "week": lambda: F.weekofyear(ts),
        "quarter": lambda: F.quarter(ts),
        "microseconds": lambda: F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(60_000_000)),
        "milliseconds": lambda: F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(60_000_000)) / 1e3,
    }
    plain = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return plain[field](ts) if field in plain else known[field]()


def date_trunc(field: str, ts: Column) -> Column:
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if field not in spans:
        return F.date_trunc(field, ts).cast("timestamp_ntz")
    n = spans[field]
    first = F.floor(F.year(ts) / n) * n if field == "decade" else F.floor((F.year(ts) - 1) / n) * n + 1
    return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")


def interval(months=0, days=0, us=0) -> Column:
    """An interval of three independent fields."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(months).cast("int").alias("months"), as_col(days).cast("int").alias("days"), as_col(us).cast("long").alias("us"))


def interval_order(i: Column) -> Column:
    """What intervals are compared by: months of 30 days, days of 24 hours."""
    return (i["months"].cast("decimal(20,0)") * 30 + i["days"]) * DAY_US + i["us"]


def justify_hours(i: Column) -> Column:
    whole = (i["us"] / DAY_US).cast("long")
    days, us = i["days"] + whole, i["us"] - whole * DAY_US
    step = F.when((days > 0) & (us < 0), 1).when((days < 0) & (us > 0), -1).otherwise(0)
    return interval(i["months"], days - step, us + step * DAY_US)


def justify_days(i: Column) -> Column:
    whole = (i["days"] / 30).cast("int")
    months, days = i["months"] + whole, i["days"] - whole * 30
    step = F.when((months > 0) & (days < 0), 1).when((months < 0) & (days > 0), -1).otherwise(0)
    return interval(months - step, days + step * 30, i["us"])


def scale(i: Column, by: float) -> Column:
    """interval × number: what is left of months goes to days, of days to time."""
    months = i["months"] * F.lit(float(by))
    days = i["days"] * F.lit(float(by)) + (months - months.cast("int")) * 30
    us = i["us"] * F.lit(float(by)) + F.round((days - days.cast("int")) * DAY_US)
    return interval(months.cast("int"), days.cast("int"), F.round(us))


def add(ts: Column, i: Column) -> Column:
    """timestamp + interval: months first (the day is clamped), then days, then time."""
    moved = F.timestamp_add("MONTH", i["months"], ts)
    moved = F.timestamp_add("DAY", i["days"], moved)
    return F.timestamp_add("MICROSECOND", i["us"], moved)


def age(a: Column, b: Column) -> Column:
    """Symbolic a - b in months, days and time; the later one first."""
    late, early = F.greatest(a, b), F.least(a, b)
    whole = F.months_between(late, early).cast("int")
    whole = F.when(F.timestamp_add("MONTH", whole, early) > late, whole - 1).otherwise(whole)
    rest = F.unix_micros(late.cast("timestamp")) - F.unix_micros(F.timestamp_add("MONTH", whole, early).cast("timestamp"))
    sign = F.when(a >= b, 1).otherwise(-1)
    days = F.floor(rest / DAY_US)
    return interval(whole * sign, days * sign, (rest - days * DAY_US) * sign)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open periods, ends in either order; two equal instants overlap."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return (a == c) | ((a < d) & (c < b))


#: Template words of the SQL side and the formatter's patterns for them.
PATTERNS = (
    ("YYYY", "yyyy"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"),
    ("MS", "SSS"), ("US", "SSSSSS"), ("Month", "MMMM"), ("Mon", "MMM"), ("Dy", "EEE"), ("Day", "EEEE"), ("YY", "yy"), ("AM", "a"), ("PM", "a"), ("Q", "Q"),
)


def translate_format(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == '"':
            j = fmt.index('"', i + 1)
            out += "'" + fmt[i + 1 : j].replace("'", "''") + "'"
            i = j + 1
            continue
        for word, to in PATTERNS:
            if fmt.startswith(word, i):
                out += to
                i += len(word)
                break
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def to_char(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, translate_format(fmt))


def to_timestamp(s: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(translate_format(fmt)))


R.sql("F_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(weekofyear(o_orderdate) AS INT) AS w FROM orders")
R.sql("F_date_plus", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate AS DATE) - 3 AS b, o_orderdate + INTERVAL 1 MONTH AS c FROM orders")
R.sql("F_date_diff", "SELECT o_orderkey, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS d FROM orders")
R.sql("F_date_make", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 3) AS d FROM nation")


@R.frame(
    "F_date_extract",
    """SELECT o_orderkey, epoch(o_orderdate) AS epoch, CAST(century(o_orderdate) AS INT) AS century, CAST(millennium(o_orderdate) AS INT) AS millennium, CAST(decade(o_orderdate) AS INT) AS decade,
       CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(isodow(o_orderdate) AS INT) AS isodow, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(isoyear(o_orderdate) AS INT) AS isoyear FROM orders""",
)
def _extract(t):
    ts = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *(extract(f, ts).alias(f) for f in ("epoch", "century", "millennium", "decade", "dow", "isodow", "doy", "isoyear")))


@R.frame("F_date_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('decade', ts) AS TIMESTAMP) AS d, TIMESTAMP '2001-01-01' AS c FROM events")
def _trunc(t):
    ts = F.col("ts")
    return t.events.select("event_id", date_trunc("hour", ts).alias("h"), date_trunc("month", ts).alias("m"), date_trunc("decade", ts).alias("d"), date_trunc("century", ts).alias("c"))


@R.frame("F_date_age", "SELECT o_orderkey, CAST(date_part('year', age(TIMESTAMP '2001-03-15 12:00:00', o_orderdate)) * 12 + date_part('month', age(TIMESTAMP '2001-03-15 12:00:00', o_orderdate)) AS INT) AS m FROM orders")
def _age(t):
    a = age(F.lit("2001-03-15 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", a["months"].alias("m"))


@R.frame("F_date_justify", "SELECT n_nationkey, CAST(n_nationkey * 7 // 24 AS INT) AS d, CAST(n_nationkey * 7 % 24 AS INT) AS h, CAST(n_nationkey * 11 // 30 AS INT) AS m, CAST(n_nationkey * 11 % 30 AS INT) AS rest FROM nation")
def _justify(t):
    a = justify_hours(interval(0, 0, F.col("n_nationkey").cast("long") * 7 * 3_600_000_000))
    b = justify_days(interval(0, F.col("n_nationkey") * 11, 0))
    return t.nation.select("n_nationkey", a["days"].alias("d"), F.floor(a["us"] / 3_600_000_000).cast("int").alias("h"), b["months"].alias("m"), b["days"].alias("rest"))


@R.frame("F_date_interval_add", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 90 MINUTE AS x FROM orders")
def _interval_add(t):
    return t.orders.select("o_orderkey", add(F.col("o_orderdate"), interval(1, 3, 90 * 60_000_000)).alias("x"))


@R.frame(
    "F_date_overlaps",
    """SELECT o_orderkey, o_orderdate = TIMESTAMP '1996-01-01' OR (o_orderdate < TIMESTAMP '1997-01-01' AND TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 30 DAY) AS o FROM orders""",
)
def _overlaps(t):
    d = F.col("o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", overlaps(d + F.expr("INTERVAL 30 DAYS"), d, at("1996-01-01"), at("1997-01-01")).alias("o"))


@R.frame("F_date_to_char", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d/%m/%y') AS b FROM events")
def _to_char(t):
    return t.events.select("event_id", to_char(F.col("ts"), "YYYY-MM-DD HH24:MI:SS").alias("a"), to_char(F.col("ts"), "DD/MM/YY").alias("b"))


@R.frame("F_date_to_timestamp", "SELECT event_id, date_trunc('second', ts) AS t FROM events")
def _to_timestamp(t):
    return t.events.select("event_id", to_timestamp(to_char(F.col("ts"), "YYYY/MM/DD HH24:MI:SS"), "YYYY/MM/DD HH24:MI:SS").alias("t"))


@R.frame("F_date_interval_scale", "SELECT n_nationkey, CAST(n_nationkey // 2 AS INT) AS m, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 15 ELSE 0 END AS INT) AS d FROM nation")
def _interval_scale(t):
    i = scale(interval(F.col("n_nationkey"), 0, 0), 0.5)
    return t.nation.select("n_nationkey", i["months"].alias("m"), i["days"].alias("d"))
