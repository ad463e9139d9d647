"""Numbers: truncating division, half-even rounding, degree functions, bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()


def int_div(a: Column, b: Column) -> Column:
    """Division of integers truncates toward zero."""
    return F.call_function("div", a, b)


def round_float(x: Column) -> Column:
    """Floats round half to even."""
    return F.rint(x)


def float_to_int(x: Column) -> Column:
    return F.rint(x).cast("int")


def numeric_to_int(x: Column) -> Column:
    """Exact numbers round half away from zero."""
    return F.round(x, 0).cast("int")


def trunc(x: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)) / scale


def _strict(ok: Column, value: Column, message: str) -> Column:
    return F.when(~ok, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def sqrt(x: Column) -> Column:
    return _strict(F.coalesce(x >= 0, F.lit(True)), F.sqrt(x), "cannot take square root of a negative number")


def ln(x: Column) -> Column:
    return _strict(F.coalesce(x > 0, F.lit(True)), F.ln(x), "cannot take logarithm of zero or a negative number")


def _degrees(x: Column, f, exact: dict[int, float]) -> Column:
    turn = F.pmod(x, F.lit(360.0))
    out = f(F.radians(x))
    for at, value in exact.items():
        out = F.when(turn == at, value).otherwise(out)
    return out


def sind(x: Column) -> Column:
    return _degrees(x, F.sin, {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5})


def cosd(x: Column) -> Column:
    return _degrees(x, F.cos, {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5})


def tand(x: Column) -> Column:
    return _degrees(x, F.tan, {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0})


def asind(x: Column) -> Column:
    return F.round(F.degrees(F.asin(x)), 12)


def atand(x: Column) -> Column:
    return F.round(F.degrees(F.atan(x)), 12)


# bit strings are texts of 0 and 1


def bit_and(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bit_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def bit_xor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when(x != y, "1").otherwise("0"))


def _bitwise(a: Column, b: Column, f) -> Column:
    same = F.length(a) == F.length(b)
    out = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), f), "")
    return F.when(~same, F.raise_error(F.lit("bit strings of different sizes")).cast("string")).otherwise(out)


def bit_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bit_shift(a: Column, by: int) -> Column:
    """Left by ``by`` (right, if negative), the length stays."""
    zeros = F.repeat(F.lit("0"), F.least(F.lit(abs(by)), F.length(a)))
    if by >= 0:
        return F.concat(F.substr(a, F.lit(by + 1)), zeros)
    return F.substr(F.concat(zeros, a), F.lit(1), F.length(a))


def get_bit(a: Column, n: int) -> Column:
    return F.substr(a, F.lit(n + 1), F.lit(1)).cast("int")


def set_bit(a: Column, n: int, value: int) -> Column:
    return F.overlay(a, F.lit(str(value)), F.lit(n + 1), F.lit(1))


R.sql("F_math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INT) AS s, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
R.sql("F_math_powers", "SELECT p_partkey, round(sqrt(p_size), 9) AS s, round(cbrt(p_size), 9) AS c, round(power(p_size, 2), 9) AS p, round(exp(p_size / 50.0), 9) AS e, round(ln(p_size), 9) AS l FROM part")
R.sql("F_math_hyperbolic", "SELECT p_partkey, round(sinh(p_size / 50.0), 8) AS a, round(cosh(p_size / 50.0), 8) AS b, round(tanh(p_size / 50.0), 8) AS c, round(asinh(p_size), 8) AS d, round(acosh(p_size), 8) AS e, round(atanh(p_size / 100.0), 8) AS f FROM part")
R.sql("F_math_bits", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, n_nationkey ^ 6 AS x, ~n_nationkey AS n, shiftleft(n_nationkey, 2) AS l, shiftright(n_nationkey, 1) AS r FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, xor(n_nationkey, 6) AS x, ~n_nationkey AS n, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation")
R.sql("F_math_modulo", "SELECT n_nationkey, (n_nationkey - 12) % 5 AS m, mod(n_nationkey, 4) AS k FROM nation")
R.sql("F_math_width_bucket", "SELECT p_partkey, CAST(width_bucket(p_retailprice, 900.0, 2000.0, 11) AS INT) AS b FROM part", "SELECT p_partkey, CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 12 ELSE floor((p_retailprice - 900) / 1100 * 11) + 1 END AS INT) AS b FROM part")
R.sql("F_math_random", "SELECT rand(42) AS r FROM nation", None)


@R.frame("F_math_int_div", "SELECT n_nationkey, (n_nationkey - 12) // 5 AS x FROM nation WHERE n_nationkey >= 12 UNION ALL SELECT n_nationkey, -((12 - n_nationkey) // 5) FROM nation WHERE n_nationkey < 12")
def _int_div(t):
    return t.nation.select("n_nationkey", int_div(F.col("n_nationkey") - 12, F.lit(5)).cast("int").alias("x"))


@R.frame("F_math_rounding", "SELECT n_nationkey, round_even(n_nationkey / 2.0, 0) AS a, CAST(round_even(n_nationkey / 2.0, 0) AS INT) AS b, CAST(round(CAST(n_nationkey / 2.0 AS DECIMAL(10,1))) AS INT) AS c, floor(n_nationkey / 2.0) AS d FROM nation")
def _rounding(t):
    x = F.col("n_nationkey") / F.lit(2.0)
    return t.nation.select("n_nationkey", round_float(x).alias("a"), float_to_int(x).alias("b"), numeric_to_int(x.cast("decimal(10,1)")).alias("c"), trunc(x).alias("d"))


@R.frame("F_math_degrees", "SELECT n_nationkey, round(sin(radians(n_nationkey * 15)), 12) + 0.0 AS s, round(cos(radians(n_nationkey * 15)), 12) + 0.0 AS c FROM nation")
def _degree(t):
    x = F.col("n_nationkey") * F.lit(15.0)
    return t.nation.select("n_nationkey", (F.round(sind(x), 12) + 0.0).alias("s"), (F.round(cosd(x), 12) + 0.0).alias("c"))


@R.frame(
    "F_math_bit_strings",
    """SELECT n_nationkey, CAST(CAST(b AS BIT) & CAST('01100' AS BIT) AS VARCHAR) AS a, CAST(CAST(b AS BIT) | CAST('01100' AS BIT) AS VARCHAR) AS o,
       CAST(xor(CAST(b AS BIT), CAST('01100' AS BIT)) AS VARCHAR) AS x, CAST(~CAST(b AS BIT) AS VARCHAR) AS n, b[3:] || '00' AS l, '0' || b[:4] AS r, CAST(b[2] AS INT) AS g, b[:1] || '1' || b[3:] AS s
       FROM (SELECT n_nationkey, lpad(bin(n_nationkey), 5, '0') AS b FROM nation)""",
)
def _bit_strings(t):
    b = F.lpad(F.bin("n_nationkey"), 5, "0")
    m = F.lit("01100")
    return t.nation.select(
        "n_nationkey", bit_and(b, m).alias("a"), bit_or(b, m).alias("o"), bit_xor(b, m).alias("x"), bit_not(b).alias("n"),
        bit_shift(b, 2).alias("l"), bit_shift(b, -1).alias("r"), get_bit(b, 1).alias("g"), set_bit(b, 1, 1).alias("s"),
    )
