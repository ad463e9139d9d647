"""Sound codes, keyed digests, escapes, identifiers, finite dates, times with zones, parsed text, joined XML."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import Registry

R = Registry()
#: Dates and timestamps that stand for minus and plus infinity.
FIRST_DATE, LAST_DATE = "0001-01-01", "9999-12-31"


def metaphone_of(word: str, most: int = 255) -> str:
    """Sound code of an English word."""
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    for start, keep in (("AE", 1), ("GN", 1), ("KN", 1), ("PN", 1), ("WR", 1)):
        if w.startswith(start):
            w = w[keep:]
    if w[0] == "X":
        w = "S" + w[1:]
    if w.startswith("WH"):
        w = "W" + w[2:]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    vowel = lambda c: c != "" and c in "AEIOU"
    front = lambda c: c != "" and c in "EIY"
    out, i = "", 0
    while i < len(w) and len(out) < most:
        c, before, after = w[i], at(i - 1), at(i + 1)
        if c == before and c != "C":
            i += 1
            continue
        if vowel(c):
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if before == "M" and after == "" else "B"
        elif c == "C":
            if after == "I" and at(i + 2) == "A":
                out += "X"
            elif after == "H":
                out += "K" if before == "S" else "X"
                i += 1
            elif front(after):
                out += "" if before == "S" else "S"
            else:
                out += "K"
        elif c == "D":
            if after == "G" and front(at(i + 2)):
                out += "J"
                i += 1
            else:
                out += "T"
        elif c == "G":
            if after == "H":
                if not (at(i + 2) != "" and not vowel(at(i + 2))) and i + 2 < len(w):
                    out += "K"
            elif after == "N" and (at(i + 2) == "" or w[i + 2 :] == "ED"):
                pass
            elif front(after) and before != "G":
                out += "J"
            else:
                out += "K"
        elif c == "H":
            out += "H" if vowel(after) and before not in tuple("CSPTG") else ""
        elif c == "K":
            out += "" if before == "C" else "K"
        elif c == "P":
            out += "F" if after == "H" else "P"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if after == "H":
                out += "X"
                i += 1
            elif after == "I" and at(i + 2) in ("O", "A"):
                out += "X"
            else:
                out += "S"
        elif c == "T":
            if after == "I" and at(i + 2) in ("O", "A"):
                out += "X"
            elif after == "H":
                out += "0"
                i += 1
            elif not (after == "C" and at(i + 2) == "H"):
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if vowel(after) else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
        i += 1
    return out[:most]


@F.pandas_udf(T.StringType())
def metaphone(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else metaphone_of(t))


def keyed_digest(kind: str):
    """HMAC in hexadecimal by a hash of hashlib."""
    hashlib.new(kind)

    @F.pandas_udf("string")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else _hmac.new(k.encode(), d.encode(), kind).hexdigest() for d, k in zip(data, key)])

    return run


@F.pandas_udf(T.StringType())
def encode_escape(b: pd.Series) -> pd.Series:
    r"""Bytes as text: zero and bytes over 127 as \ooo, a backslash twice."""
    one = lambda x: "".join("\\\\" if c == 92 else chr(c) if 0 < c < 128 else f"\\{c:03o}" for c in x)
    return b.map(lambda x: None if x is None else one(bytes(x)))


@F.pandas_udf(T.BinaryType())
def decode_escape(s: pd.Series) -> pd.Series:
    back = lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8)])
    return s.map(lambda t: None if t is None else re.sub(rb"\\(\\|[0-3][0-7]{2})", back, t.encode("latin-1")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_ident(s: pd.Series) -> pd.Series:
    """A qualified identifier as its parts: quoted ones as they stand, others in lower case."""

    def one(t):
        parts = re.findall(r'\s*(?:"((?:[^"]|"")*)"|([^\W\d][\w$]*))\s*(\.|$)', t)
        if "".join(re.findall(r'\s*(?:"(?:[^"]|"")*"|[^\W\d][\w$]*)\s*(?:\.|$)', t)) != t or not parts or parts[-1][2] == ".":
            raise ValueError(f"string is not a valid identifier: {t!r}")
        return [q.replace('""', '"') if q else w.lower() for q, w, _ in parts]

    return s.map(lambda t: None if t is None else one(t))


def is_finite(d: Column) -> Column:
    day = d.cast("date")
    return (day != F.lit(FIRST_DATE).cast("date")) & (day != F.lit(LAST_DATE).cast("date"))


def timetz(seconds: Column, zone: Column) -> Column:
    """A time of day with its offset from UTC, both in seconds (east is positive)."""
    return F.struct(seconds.cast("long").alias("seconds"), zone.cast("int").alias("zone"))


def timetz_order(t: Column) -> Column:
    """By the moment in UTC, then the zone farther west."""
    return F.struct((t["seconds"] - t["zone"]).alias("utc"), (-t["zone"]).alias("west"))


def time_add(seconds: Column, interval_us: Column) -> Column:
    """time + interval wraps at midnight."""
    return F.pmod(seconds + F.floor(interval_us / 1_000_000), F.lit(86_400))


#: Kinds of tokens, by what a token looks like; the first that fits counts.
KINDS = (
    ("url", r"https?://\S+"), ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), ("float", r"-?\d+\.\d+(?:e-?\d+)?"), ("int", r"-?\d+"),
    ("asciiword", r"[A-Za-z]+(?![^\W\d_])"), ("word", r"[^\W\d_]+"), ("numword", r"\w+"), ("blank", r"\s+"), ("symbol", r"[^\w\s]"),
)


def ts_parse(text: Column) -> Column:
    """array of struct(kind, token)."""
    any_ = "(?U)" + "|".join(f"(?:{p})" for _, p in KINDS)

    def kind(x: Column) -> Column:
        out = F.lit(KINDS[-1][0])
        for name, pattern in reversed(KINDS[:-1]):
            out = F.when(x.rlike(f"(?U)^(?:{pattern})$"), name).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(any_), F.lit(0)), lambda x: F.struct(kind(x).alias("kind"), x.alias("token")))


def set_weight(v: Column, weight: str) -> Column:
    """A vector of lexemes with positions, each marked with a weight from A to D."""
    return F.transform(v, lambda x: F.struct(x.lexeme.alias("lexeme"), x.position.alias("position"), F.lit(weight).alias("weight")))


def filter_weights(v: Column, *weights: str) -> Column:
    return F.filter(v, lambda x: x.weight.isin(*weights))


def xml_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_element(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), xml_escape(body), F.lit(f"</{name}>"))


def xml_agg(element: Column, order: Column) -> Column:
    held = F.sort_array(F.collect_list(F.struct(order.alias("o"), element.alias("v"))))
    return F.array_join(F.transform(held, lambda x: x.v), "")


@R.frame("F_xml_agg", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_nationkey) AS x FROM nation GROUP BY n_regionkey")
def _xml_agg(t):
    return t.nation.groupBy("n_regionkey").agg(xml_agg(xml_element("n", F.col("n_name")), F.col("n_nationkey")).alias("x"))


@R.frame("F_date_finite", "SELECT o_orderkey, true AS f FROM orders")
def _finite(t):
    return t.orders.select("o_orderkey", is_finite(F.col("o_orderdate")).alias("f"))


@R.frame("F_time_wrap", "SELECT n_nationkey, CAST((n_nationkey * 7200 + 7200) % 86400 AS BIGINT) AS s FROM nation")
def _time(t):
    return t.nation.select("n_nationkey", time_add(F.col("n_nationkey") * 7200, F.lit(7_200_000_000)).cast("long").alias("s"))


@R.frame("F_str_identifier", "SELECT n_nationkey, lower(n_name) AS a, n_name AS b FROM nation")
def _ident(t):
    parts = parse_ident(F.concat(F.col("n_name"), F.lit('."'), F.col("n_name"), F.lit('"')))
    return t.nation.select("n_nationkey", parts.alias("p")).select("n_nationkey", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


@R.frame("F_str_metaphone", None)
def _metaphone(t):
    return t.part.select("p_partkey", metaphone("p_name").alias("m"))


@R.frame("F_str_hmac", None)
def _keyed(t):
    return t.nation.select("n_nationkey", keyed_digest("sha256")("n_name", F.lit("key")).alias("h"))


@R.frame("F_text_parse", None)
def _parse(t):
    return t.benchmark.select("item_id", F.size(F.filter(ts_parse(F.col("text")), lambda x: x.kind == "asciiword")).cast("long").alias("n"))
