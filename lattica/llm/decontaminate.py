"""Benchmark decontamination by winnowing (DataFrame functions only).

Of every ``n`` consecutive words, ``k``-grams are hashed, and in each run of
``w = n - k + 1`` k-grams the smallest hash is kept, with every position that
holds it.  A training text and a benchmark item which share ``n`` words share
such a run, so both keep the same hash at the same place of it: the join of the
kept hashes misses no shared span.  Each joined hit is extended to the whole
window and compared word by word, so the result is exact.

The documents are read once and never shuffled: the kept hashes are probed in
place, and only verified hits and one row for each document go to the
aggregation.  Benchmarks whose windows exceed ``broadcast_limit`` bytes are
joined by a shuffle instead, with each kept hash carrying its own words.
(The generators are outer ones, so that no filter on their arrays is inferred:
pushed through the chain of array expressions, it would repeat them.)

Defined cases: null or wordless texts have no words and no hits; a wordless
item has no window; an item shorter than ``n`` words is one window of its own
length (its family of k-grams has k = its length, and w = 1); repeated rows of
documents each get their own row; items with the same window are all reported;
null item ids are left out of the lists; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fold, materialize

#: Everything but ASCII controls, punctuation, upper-case letters and space.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM = 10
KGRAM = 7
#: Windows of the benchmark that may be broadcast, in bytes of their file.
BROADCAST_LIMIT = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def _shift(x: Column, by: int) -> Column:
    """x without its first ``by`` elements (shorter or equal lengths give none)."""
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def _slide(df: DataFrame, column: str, length: int, pair) -> DataFrame:
    """Fold ``length`` consecutive elements by ``pair``, by doubling.

    ``pair`` joins the fold of a run with that of the run ``step`` later; where
    the two overlap it must not matter (min, max) or be part of the hash.
    """
    have = 1
    while have < length:
        step = min(have, length - have)
        x = F.col(column)
        size = F.size(x)
        df = df.withColumn(
            column,
            F.zip_with(F.slice(x, 1, F.greatest(size - step, F.lit(0))), _shift(x, step), pair),
        )
        have += step
    return df


def _grams(df: DataFrame, words_col: str, out: str, k: int) -> DataFrame:
    df = df.withColumn(out, F.transform(F.col(words_col), lambda w: F.xxhash64(w)))
    return _slide(df, out, k, lambda a, b: F.xxhash64(a, b))


def kept(df: DataFrame, words_col: str, out: str, k: int, w: int) -> DataFrame:
    """Add ``out``: the k-gram hash at each kept position, null elsewhere."""
    df = _grams(df, words_col, out, k)
    if w == 1:
        return df
    low = df.withColumn("_min", F.col(out))
    low = _slide(low, "_min", w, lambda a, b: F.least(a, b))
    # a position is kept if it holds the minimum of a run that covers it: if the largest of those minima is its hash
    edge = F.array_repeat(F.lit(None).cast("long"), w - 1)
    has_run = F.size("_min") > 0
    low = low.withColumn("_max", F.when(has_run, F.concat(edge, F.col("_min"), edge)).otherwise(F.array().cast("array<bigint>")))
    low = _slide(low, "_max", w, lambda a, b: F.greatest(a, b))
    return low.withColumn(
        out, F.zip_with(F.slice(F.col(out), 1, F.size("_max")), F.col("_max"), lambda g, m: F.when(g == m, g))
    ).drop("_min", "_max")


def _windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Distinct windows: win (words), len, items (sorted ids as strings)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("win"))
    return w.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("win"))


def _keys(windows: DataFrame, n: int, k: int, w: int) -> DataFrame:
    """Kept hashes of windows of ``n`` words: fp, off (of the hash in the window)."""
    got = kept(windows.where(F.col("len") == n), "win", "fp", k, w)
    return got.select("win", "items", F.posexplode_outer("fp").alias("off", "fp")).where("fp is not null")


def _hits(rows: DataFrame, keys: DataFrame, n: int, small: bool, w: int) -> DataFrame:
    """(uid, id, n_words, s, e, items): the marker row of each document, and verified windows.

    rows: uid, id, words, n_words, fps, whose first element is null for the marker.
    """
    if small:
        at = rows.select("uid", "id", "n_words", "words", F.posexplode_outer("fps").alias("p", "fp")).where(
            "fp is not null or p = 0"
        )
        hit = at.join(F.broadcast(keys), "fp", "left")
        start = F.col("p") - 1 - F.col("off")
        ok = (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, n) == F.col("win"))
    else:
        around = F.transform(
            F.filter(F.transform(F.col("fps"), lambda f, i: F.struct(i.alias("p"), f.alias("fp"))), lambda x: x.fp.isNotNull() | (x.p == 0)),
            lambda x: F.struct(
                x.p.alias("p"),
                x.fp.alias("fp"),
                F.greatest(x.p - w, F.lit(0)).alias("base"),
                F.slice(F.col("words"), F.greatest(x.p - w, F.lit(0)) + 1, n + w).alias("ctx"),
            ),
        )
        at = rows.select("uid", "id", "n_words", F.inline_outer(around))
        hit = at.join(keys, "fp", "left")
        start = F.col("p") - 1 - F.col("off")
        ok = (start >= 0) & (F.slice("ctx", F.greatest(start - F.col("base"), F.lit(0)) + 1, n) == F.col("win"))
    return hit.where((F.col("p") == 0) | ok).select(
        "uid", "id", "n_words",
        F.when(F.col("p") > 0, F.struct(start.alias("s"), (start + n).alias("e"))).alias("span"),
        F.when(F.col("p") > 0, F.col("items")).alias("items"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    ngram: int = NGRAM,
    kgram: int = KGRAM,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the sorted starts and ends (in words, end exclusive) of the
    windows found, ``items`` the sorted ids of items with a window found.
    """
    if not 1 <= kgram <= ngram:
        raise ValueError("kgram must be from 1 to ngram")
    windows = materialize(_windows(benchmark, item_id, item_text, ngram))
    small = bytes_of(windows) <= broadcast_limit
    # at most ngram lengths
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    base = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("id"), words(F.col(text)).alias("words")
    ).withColumn("n_words", F.size("words").cast("long"))
    marker = F.array(F.lit(None).cast("long"))
    found = None
    for n in [m for m in lengths if m != ngram] + [ngram]:
        k, w = (kgram, ngram - kgram + 1) if n == ngram else (n, 1)
        rows = kept(base, "words", "fps", k, w).withColumn("fps", F.concat(marker, F.col("fps")))
        part = _hits(rows, _keys(windows, n, k, w), n, small, w)
        if n != ngram:
            part = part.where("span is not null")
        found = part if found is None else found.unionByName(part)
    per_doc = found.groupBy("uid").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc.upto, x.e).alias("upto"),
            (acc.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.upto))).cast("long").alias("n"),
        ),
        lambda acc: acc.n,
    )
    return per_doc.select(
        F.col("id").alias(doc_id), "n_words", covered.alias("n_hit"), "spans", "items",
        (F.size("spans") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
doc_win AS (
  SELECT uid, n, unnest(range(1, len(w) - n + 2)) AS s,
         unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS win
  FROM d, lens),
hit AS (SELECT uid, s, n, item FROM doc_win JOIN win USING (n, win)),
pos AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY uid),
its AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT uid, item FROM hit) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (uid) LEFT JOIN its USING (uid)
"""
