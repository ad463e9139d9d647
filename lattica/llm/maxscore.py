"""Exact top-k inner products by MaxScore over shards of postings.

A vector's dimensions are its terms; a shard keeps for each term the postings
(the rows and their values) and the least and largest value.  For a query
these bound what each term can add to a score.  Terms are put in order of the
spread of their bounds; the trailing ones whose bounds together stay under the
query's running threshold are non-essential.  The essential postings are
traversed in full; rows that cannot reach the threshold any more are dropped,
and the rest probe the non-essential terms in groups while they stay
competitive.  Rows without an essential posting are scored as zero there and
held to the same test, so the result is exact for values of either sign.
Scores are integers, held exactly in doubles (a larger range is refused).

Queries and candidates meet in blocks: candidates are dealt by hash into shards
of ``shard_rows``, queries into blocks of ``query_rows``, and each task sees one
block against one shard.  The best ``k`` of each are merged with a ranked
window, which Spark limits before its exchange.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither as query nor as candidate; empty vectors score zero with every
other; vectors of different lengths are padded with zeros; repeated rows are
candidates each, and query rows that share an id are ranked together; a row is not
its own candidate, nor are rows that share its id; ties go to the smaller id; null
ids take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
SHARD_ROWS = 16384
QUERY_ROWS = 4096
#: Terms probed before the survivors are looked at again.
PROBE = 16
#: Candidates taken together inside a shard, so that the threshold rises early.
STRIDE = 4096


class Shard:
    """Rows of integer vectors with bounds and postings by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.terms = np.asfortranarray(rows)  # a column holds a term's postings
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)

    def top(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of all rows that may be among the best k, given that ``floor`` is reached k times."""
        low, high = np.minimum(query * self.low, query * self.high), np.maximum(query * self.low, query * self.high)
        order = np.argsort(low - high, kind="stable")
        rest = np.r_[np.cumsum(high[order][::-1])[::-1], 0.0]
        # the terms after ``cut`` cannot lift a row without other postings over the floor
        cut = max(int(np.searchsorted(-rest, -floor)), min(PROBE, len(order))) if np.isfinite(floor) else len(order)
        cut = min(cut, len(order))
        score = self.terms[:, order[:cut]] @ query[order[:cut]] if cut else np.zeros(len(self.ids))
        alive = np.flatnonzero((score + rest[cut] >= floor) & (self.ids != own))
        score = score[alive]
        while cut < len(order) and len(alive):
            to = min(cut + PROBE, len(order))
            score = score + self.rows[alive][:, order[cut:to]] @ query[order[cut:to]]
            cut = to
            keep = score + rest[cut] >= floor
            alive, score = alive[keep], score[keep]
        return self.ids[alive], score


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over = score >= least
        ids, score = ids[over], score[over]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.array(vectors.tolist(), float).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_block(k: int) -> Callable:
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(queries.v.map(len).max(), rows.v.map(len).max())
        wanted, values = _matrix(queries.v, width), _matrix(rows.v, width)
        if width and np.abs(wanted).max() * np.abs(values).max() * width >= 2.0**53:
            raise ValueError("the vectors' scores are too large for exact sums")
        order = np.argsort(rows.vec_id.to_numpy(), kind="stable")
        ids, values = rows.vec_id.to_numpy()[order], values[order]
        shards = [Shard(ids[i : i + STRIDE], values[i : i + STRIDE]) for i in range(0, len(ids), STRIDE)]
        found = []
        for query_id, query in zip(queries.vec_id.to_numpy(), wanted):
            got, score, floor = np.zeros(0, ids.dtype), np.zeros(0), -np.inf
            for shard in shards:
                new, new_score = shard.top(query, query_id, k, floor)
                got, score = best(np.r_[got, new], np.r_[score, new_score], k)
                if len(got) == k:
                    floor = score[-1]
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": got, "score": score.astype("int64")}))
        return pd.concat(found)

    return run


def integers(vector: Column) -> Column:
    """floor(64 x) of each component, as doubles hold it."""
    return F.transform(vector, lambda x: F.floor(64 * x.cast("double")).cast("double"))


def top_k(
    rows: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite)
    usable = usable.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector)).alias("v"), is_query.alias("asks"))
    usable = materialize(usable)
    n, asked = usable.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_rows))
    part = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = usable.where("asks").select("vec_id", "v", part(blocks, 1).alias("block"), every(shards).alias("shard"))
    dealt = usable.select("vec_id", "v", part(shards, 2).alias("shard"), every(blocks).alias("block"))
    met = queries.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
    found = met.applyInPandas(search_block(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
