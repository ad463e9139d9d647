"""Queries over the standard tables, and the SQL that gives the same rows."""

from __future__ import annotations

from ..functions import collections, datetime, geometry, maths, more, network, ranges, strings, text_search
from ..operators import aggregates, joins, predicates, scans, sorts_sets, user_defined, windows
from ..streaming import windows as streaming

MODULES = (scans, predicates, joins, aggregates, windows, sorts_sets, user_defined, strings, datetime, maths, collections, more, ranges, geometry, network, text_search, streaming)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
