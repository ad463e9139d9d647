"""Near-duplicates by their share of five-word shingles, against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import near_sets, simhash

from .test_brute import EDGE, plain_components, texts


def plain_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_least(given):
    """Each row's least id of its component."""
    sets = [plain_set(t) for _, t in given]
    near = lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b) and bool(a & b))
    roots = plain_components(sets, near)
    least = {}
    for (d, _), r in zip(given, roots):
        least[r] = min(d, least.get(r, d))
    return {d: least[r] for (d, _), r in zip(given, roots)}


def prose(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('bcdfgklm')}{draw.choice('aeiou')}{draw.randrange(900)}" for _ in range(n)]


def edited(words, places):
    return [f"other{i}" if i in places else w for i, w in enumerate(words)]


def crowd():
    """A group of near copies, a chain, a passage that texts of other kinds share, and copies."""
    base, chain, passage = prose(1, 120), prose(2, 100), prose(3, 40)
    given = [(i, edited(base, {i})) for i in range(40)]
    given += [(100 + i, edited(chain, set(range(0, 2 * i, 2)))) for i in range(6)]
    given += [(200 + i, passage + prose(50 + i, 4 + 3 * i)) for i in range(30)]
    given += [(300 + i, prose(9, 60)) for i in range(5)] + [(400, prose(10, 3)), (401, prose(10, 3))]
    return [(d, " ".join(w)) for d, w in given]


@pytest.mark.parametrize("cap", [1, 3, 32])
def test_all_pairs(spark, cap):
    given = crowd()
    got = near_sets.verified_duplicates(spark.createDataFrame(given, "doc_id long, text string"), cap=cap)
    assert {r.doc_id: r.component_id for r in got.collect()} == plain_least(given)


def test_whole_table(spark, sf):
    given = [(d, t) for d, t in texts(sf) if t is None or t.isascii()]
    got = near_sets.verified_duplicates(spark.createDataFrame(given, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == plain_least(given)


def test_stage_drops_edited_copies(spark, sf):
    words = prose(7, 120)
    given = [(1, " ".join(words)), (2, " ".join(edited(words, {20, 80}))), (3, " ".join(prose(8, 120)))]
    assert (simhash.fingerprint(given[0][1]) ^ simhash.fingerprint(given[1][1])).bit_count() > 4
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3]


def test_edges(spark):
    rows = [(None, "a b c d e f"), (5, "A b c d e f"), (6, None), (7, ""), (8, "a b"), (None, "x")]
    got = near_sets.verified_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got.collect() if r.component_id) == [(False, 5, 5), (False, 6, 6), (False, 7, 6), (False, 8, 8), (True, 0, 5)]
    assert near_sets.verified_duplicates(spark.createDataFrame(EDGE, "doc_id long, text string")).count() == len(EDGE)
    assert near_sets.verified_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_path_takes_few_rounds(spark):
    from pyspark.sql import functions as F

    from lattica.llm.common import materialize
    from lattica.llm.components import connected_components, contractions

    path = materialize(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert len(contractions(path)) <= 10
    assert {r.root for r in connected_components(path).collect()} == {0}


def test_marks_rule_out_no_pair_with_the_share():
    rng = np.random.default_rng(5)
    ruled = 0
    for size in (1, 3, 9, 40, 150, 900, 5000):
        for _ in range(60):
            both = rng.integers(-(1 << 63), (1 << 63) - 1, 2 * size, dtype=np.int64)
            cut = int(rng.integers(0, max(1, size // 5) + 1))
            a, b = np.unique(both[:size]), np.unique(both[cut : size + cut])
            marks = np.frombuffer(near_sets.mark(a) + near_sets.mark(b), np.uint64).reshape(2, -1)
            may = near_sets.may_share(marks, np.array([len(a), len(b)]), np.array([0]), np.array([1]))[0]
            share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert may or share < 0.8
            ruled += not may
    assert ruled > 50
