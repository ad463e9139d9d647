"""From plans to DataFrames: the chosen tree as nested joins, which Catalyst keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cost import Plan
from .graph import QueryGraph
from .heuristics import optimize
from .stats import Input, build_graph, classes_of


def to_dataframe(plan: Plan, graph: QueryGraph, frames: list[DataFrame]) -> DataFrame:
    """Join as the tree says; frames must not share column names.

    One predicate for each class with columns on both sides is enough: each side
    already holds its own members equal.
    """
    if plan.leaf:
        return frames[plan.mask.bit_length() - 1]
    left, right = (to_dataframe(side, graph, frames) for side in (plan.left, plan.right))
    on = [F.col(c) == F.col(d) for _, c, _, d in graph.shared_columns(plan.left.mask, plan.right.mask)]
    return left.join(right, reduce(lambda a, b: a & b, on))


def join_all(inputs: list[Input], predicates: list[tuple[str, str, str, str]], algorithm: str | None = None, model: str = "rows") -> DataFrame:
    """The inner equi-join of all inputs in an optimized order.

    Equalities of two columns of one table become filters.  Components without
    a predicate between them are crossed last, those with fewest rows first.
    """
    inside: dict[str, list] = {x.name: [] for x in inputs}
    groups = classes_of(predicates)
    for t, c, u, d in predicates:
        for name, column in ((t, c), (u, d)):
            kept = next((g[name] for g in groups if name in g and _same_class(g, name, column, predicates)), column)
            if kept != column:
                inside[name].append(F.col(kept) == F.col(column))
    frames = [reduce(lambda df, f: df.where(f), inside[x.name], x.filtered) for x in inputs]
    graph = build_graph(inputs, predicates)
    parts = [to_dataframe(p, graph, frames) for p in optimize(graph, algorithm, model)]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def _same_class(group: dict[str, str], table: str, column: str, predicates) -> bool:
    """Whether ``column`` belongs to the class of which ``group`` shows one column a table."""
    start = (table, group[table])
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for t, c, u, d in predicates:
            for a, b in (((t, c), (u, d)), ((u, d), (t, c))):
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
    return (table, column) in seen


def drop_useless_outer_join(left: DataFrame, right: DataFrame, on: tuple[str, str], used: list[str], right_unique: bool) -> DataFrame:
    """A left join whose right side has a unique key and gives no used column changes nothing: leave it out."""
    if right_unique and not set(used) & set(right.columns):
        return left.select(*used)
    return left.join(right, left[on[0]] == right[on[1]], "left").select(*used)
