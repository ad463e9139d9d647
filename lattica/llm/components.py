"""Connected components of an edge table by repeated contraction.

Each round gives all nodes a new order by a seeded hash, points every node at the
least of itself and its neighbours, follows that pointer once more, replaces the
ends of every edge by what they point at, and drops loops and repeats.  As the
order is new each time, a constant share of the nodes disappears in each round
whatever the graph looks like (a path too), so that the rounds grow with the
logarithm of the number of nodes.  Pointers of all rounds are composed at the end,
and each component is named by its least node.  All steps are joins and minima over
written tables (lost executors cost a task, not a round), and joins read both
sides from an exchange, so that adaptive execution can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def contractions(edges: DataFrame) -> list[DataFrame]:
    """The pointers (x, px) of each round; edges: distinct (a, b) with a < b, written."""
    e, rounds = edges, []
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("y"))
        near = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.select(F.col("a").alias("x"), order("b").alias("o")).groupBy("x").agg(F.min("o").alias("o"))
        p = materialize(least.select("x", F.least("o", order("x")).getField("y").alias("px")))
        then = p.select(F.col("x").alias("px"), F.col("px").alias("ppx"))
        p = materialize(p.join(then, "px").select("x", F.col("ppx").alias("px")))
        rounds.append(p)
        left = e.join(p, e.a == p.x).select(F.col("px").alias("a"), "b")
        both = left.join(p, left.b == p.x).select("a", F.col("px").alias("b")).where("a <> b")
        e = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return rounds


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node reachable.

    Loops, repeats and edges with a null end are ignored; an empty table gives
    no rows.
    """
    with scratch() as own:
        return own.keep(_components(edges, a, b))


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = materialize(edges.sparkSession.createDataFrame([], e.schema).union(e))
    rounds = contractions(e)
    if not rounds:
        return materialize(e.select(F.col("a").alias("node"), F.col("b").alias("root")))
    done = rounds[0].select(F.col("x").alias("node"), F.col("px").alias("root"))
    for p in rounds[1:]:
        done = materialize(done.join(p, done.root == p.x, "left").select("node", F.coalesce("px", "root").alias("root")))
    least = materialize(done.groupBy("root").agg(F.min("node").alias("least")))
    return materialize(done.join(least, "root").select("node", F.col("least").alias("root")))
