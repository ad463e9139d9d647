"""String functions whose rules differ from Spark's own."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import Registry

R = Registry()


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """Positions count from 1, and those before 1 count too: from 0 for 3 gives two characters."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.substr(s, F.greatest(start, F.lit(1)))
    length = F.lit(length) if isinstance(length, int) else length
    length = F.when(length < 0, F.raise_error(F.lit("negative substring length not allowed")).cast("int")).otherwise(length)
    end = start + length
    return F.substr(s, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)), F.lit(0)))


def split_part(s: Column, sep: str, n: int) -> Column:
    if n < 1:
        raise ValueError("field position must be greater than zero")
    return F.split_part(s, F.lit(sep), F.lit(n))


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def regexp_replace(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """The first match only, unless flags hold ``g``; ``\\1`` names a group, ``i`` ignores case."""
    to = "".join("$" + to[i + 1] if c == "\\" and i + 1 < len(to) and to[i + 1].isdigit() else "" if i and to[i - 1] == "\\" and c.isdigit() else "\\$" if c == "$" else c for i, c in enumerate(to))
    fold = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(s, fold + pattern, to)
    shifted = "".join("$" + str(int(to[i + 1]) + 1) if c == "$" and to[i + 1 : i + 2].isdigit() and (not i or to[i - 1] != "\\") else "" if i and to[i - 1] == "$" and c.isdigit() and (i < 2 or to[i - 2] != "\\") else c for i, c in enumerate(to))
    return F.regexp_replace(s, rf"\A([\s\S]*?){fold}(?:{pattern})", "$1" + shifted)


def quote_ident(s: Column) -> Column:
    plain = s.rlike(r"^[a-z_][a-z0-9_$]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s: Column) -> Column:
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    slashed = F.concat(F.lit(" E'"), F.replace(doubled, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), slashed).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def format_text(template: str, *args: Column) -> Column:
    """%s, %I (identifier), %L (literal), %% and positions such as %2$s."""
    out, i, at = [], 0, 0
    while i < len(template):
        j = template.find("%", i)
        if j < 0:
            out.append(F.lit(template[i:]))
            break
        out.append(F.lit(template[i:j]))
        j += 1
        if template[j] == "%":
            out.append(F.lit("%"))
            i = j + 1
            continue
        k = j
        while template[k].isdigit():
            k += 1
        if k > j and template[k] == "$":
            at, j = int(template[j:k]) - 1, k + 1
        arg = args[at].cast("string")
        kinds = {"s": lambda a: F.coalesce(a, F.lit("")), "I": quote_ident, "L": quote_nullable}
        out.append(kinds[template[j]](arg))
        at, i = at + 1, j + 1
    return F.concat(*out)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def show_trgm(s: Column) -> Column:
    """The set of trigrams of a text's words, each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))))


def similarity(a: Column, b: Column) -> Column:
    x, y = show_trgm(a), show_trgm(b)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def difference(a: Column, b: Column) -> Column:
    """How many of the four places of two soundex codes agree."""
    x, y = F.soundex(a), F.soundex(b)
    return sum((F.substr(x, F.lit(i), F.lit(1)) == F.substr(y, F.lit(i), F.lit(1))).cast("int") for i in range(1, 5))


@F.pandas_udf(T.StringType())
def unaccent(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def to_ascii(s: Column) -> Column:
    return F.translate(s, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def levenshtein_weighted(insert: int, delete: int, replace: int):
    """Edit distance with own costs."""

    def one(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        row = [j * insert for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i * delete
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + delete, row[j - 1] + insert, last + (0 if x == y else replace))
        return row[-1]

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")

    return run


def check_digit_ean13(digits: Column) -> Column:
    """The last digit of a 13-digit article number, from its first twelve."""
    d = lambda i: F.substr(digits, F.lit(i), F.lit(1)).cast("int")
    total = sum((d(i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def isbn13_to_10(isbn: Column) -> Column:
    """The ten-digit number of one that starts with 978."""
    body = F.substr(isbn, F.lit(4), F.lit(9))
    total = sum((F.substr(body, F.lit(i + 1), F.lit(1)).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    last = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
    return F.concat(body, F.when(last == 10, F.lit("X")).otherwise(last.cast("string")))


R.sql("F_str_basic", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INT) AS n, reverse(p_brand) AS r, left(p_name, 3) AS a, right(p_name, 3) AS z, repeat('x', 3) AS x3 FROM part")
R.sql("F_str_trim", "SELECT trim(a) AS t, ltrim(a) AS l, rtrim(a) AS r, trim(BOTH 'x' FROM b) AS x FROM (VALUES ('  a b ', 'xxhixx'), ('', 'x')) AS t(a, b)")
R.sql("F_str_position", "SELECT p_partkey, CAST(position('a' IN p_name) AS INT) AS p, CAST(instr(p_name, 'e') AS INT) AS i FROM part")
R.sql("F_str_pad", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 4, '-') AS r FROM nation")
R.sql("F_str_translate", "SELECT n_nationkey, translate(n_name, 'AEI', 'aei') AS t, replace(n_name, 'A', '') AS r FROM nation")
R.sql("F_str_ascii_chr", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_nationkey) AS c FROM nation", "SELECT n_nationkey, ascii(n_name) AS a, chr(CAST(65 + n_nationkey AS INT)) AS c FROM nation")
R.sql("F_str_overlay", "SELECT n_nationkey, overlay(n_name PLACING 'xx' FROM 2 FOR 3) AS o FROM nation", "SELECT n_nationkey, n_name[:1] || 'xx' || n_name[5:] AS o FROM nation")
R.sql("F_str_lengths", "SELECT doc_id, octet_length(text) AS o, bit_length(text) AS b, CAST(char_length(text) AS INT) AS c FROM documents", "SELECT doc_id, CAST(strlen(text) AS INT) AS o, CAST(strlen(text) * 8 AS INT) AS b, CAST(length(text) AS INT) AS c FROM documents")
R.sql("F_str_hashes", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
R.sql("F_str_levenshtein", "SELECT n_nationkey, CAST(levenshtein(n_name, 'NATION_10') AS INT) AS d FROM nation")
R.sql("F_str_initcap", "SELECT p_partkey, initcap(p_name) AS i FROM part", "SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS i FROM part")
R.sql("F_str_concat_op", "SELECT n_nationkey, n_name || '-' || n_regionkey AS c, n_name || NULL AS z FROM nation")
R.sql("F_str_encode", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(CAST(n_name AS BINARY)) AS b FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b FROM nation")
R.sql("F_str_regexp_split", "SELECT p_partkey, CAST(size(split(p_name, '[ae]')) AS INT) AS n FROM part", "SELECT p_partkey, CAST(len(regexp_split_to_array(p_name, '[ae]')) AS INT) AS n FROM part")


@R.frame("F_str_substring", "SELECT n_nationkey, substring(n_name, 2, 3) AS a, substring(n_name, 1, 2) AS b, substring(n_name, 1, 1) AS c, '' AS d, substring(n_name, 4) AS e FROM nation")
def _substring(t):
    s = F.col("n_name")
    return t.nation.select("n_nationkey", substring(s, 2, 3).alias("a"), substring(s, 0, 3).alias("b"), substring(s, -2, 4).alias("c"), substring(s, -5, 3).alias("d"), substring(s, 4).alias("e"))


@R.frame("F_str_split_part", "SELECT c_custkey, split_part(c_name, '#', 2) AS a, split_part(c_name, '#', 3) AS b FROM customer")
def _split_part(t):
    return t.customer.select("c_custkey", split_part(F.col("c_name"), "#", 2).alias("a"), split_part(F.col("c_name"), "#", 3).alias("b"))


@R.frame("F_str_concat", "SELECT n_nationkey, concat(n_name, NULL, n_regionkey) AS c FROM nation")
def _concat(t):
    return t.nation.select("n_nationkey", concat(F.col("n_name"), F.lit(None).cast("string"), F.col("n_regionkey").cast("string")).alias("c"))


@R.frame("F_str_regexp_replace", r"SELECT p_partkey, regexp_replace(p_name, '[aeiou](.)', '<\1>') AS a, regexp_replace(p_name, '[aeiou](.)', '<\1>', 'g') AS b FROM part")
def _regexp_replace(t):
    s = F.col("p_name")
    return t.part.select("p_partkey", regexp_replace(s, "[aeiou](.)", "<\\1>").alias("a"), regexp_replace(s, "[aeiou](.)", "<\\1>", "g").alias("b"))


@R.frame("F_str_regexp_match", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS a, array_to_string(regexp_extract_all(p_name, '[a-z]o'), ',') AS b FROM part")
def _regexp_match(t):
    return t.part.select(
        "p_partkey", F.regexp_extract("p_brand", "#([0-9])([0-9])", 2).alias("a"), F.array_join(F.regexp_extract_all("p_name", F.lit("[a-z]o"), F.lit(0)), ",").alias("b")
    )


@R.frame("F_str_quote_format", """SELECT n_nationkey, '"' || n_name || '"' AS a, '''' || n_name || '''' AS b, 'in ' || n_regionkey || ': "' || n_name || '" = ''' || n_name || ''' 100%' AS c FROM nation""")
def _quote(t):
    name = F.col("n_name")
    return t.nation.select("n_nationkey", quote_ident(name).alias("a"), quote_literal(name).alias("b"), format_text("in %2$s: %1$I = %1$L 100%%", name, F.col("n_regionkey")).alias("c"))


@R.frame("F_str_to_hex", "SELECT c_custkey, lower(to_hex(c_custkey * 1000)) AS h FROM customer")
def _to_hex(t):
    return t.customer.select("c_custkey", to_hex(F.col("c_custkey") * 1000).alias("h"))


@R.frame(
    "F_str_trigram",
    """WITH g AS (SELECT n_nationkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda w: w <> ''),
         lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))) AS a,
         list_distinct(list_transform(range(1, 9), lambda i: ('  nation ')[i:i + 2])) AS b FROM nation)
       SELECT n_nationkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS s FROM (SELECT n_nationkey, a, list_filter(b, lambda x: length(x) = 3) AS b FROM g)""",
)
def _trigram(t):
    return t.nation.select("n_nationkey", F.round(similarity(F.col("n_name"), F.lit("nation")), 9).alias("s"))


@R.frame("F_str_unaccent", "SELECT doc_id, strip_accents(text) AS t FROM documents")
def _unaccent(t):
    return t.documents.select("doc_id", unaccent("text").alias("t"))


@R.frame("F_str_soundex", None)
def _soundex(t):
    return t.part.select("p_partkey", F.soundex("p_name").alias("s"), difference(F.col("p_name"), F.lit("almond")).alias("d"))


@R.frame("F_str_article_numbers", "SELECT c_custkey, CAST((10 - (9 + 3 * 7 + 8 + 3 * (c_custkey // 100000000 % 10) + (c_custkey // 10000000 % 10) + 3 * (c_custkey // 1000000 % 10) + (c_custkey // 100000 % 10) + 3 * (c_custkey // 10000 % 10) + (c_custkey // 1000 % 10) + 3 * (c_custkey // 100 % 10) + (c_custkey // 10 % 10) + 3 * (c_custkey % 10)) % 10) % 10 AS INT) AS d FROM customer")
def _isn(t):
    return t.customer.select("c_custkey", check_digit_ean13(F.concat(F.lit("978"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("d"))


@R.frame("F_str_weighted_edit", "SELECT n_nationkey, CAST(levenshtein(n_name, 'NATION_1') AS INT) AS d FROM nation")
def _weighted(t):
    return t.nation.select("n_nationkey", levenshtein_weighted(1, 1, 1)("n_name", F.lit("NATION_1")).alias("d"))
