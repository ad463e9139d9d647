"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import bpe
from lattica.llm.common import materialize
from lattica.llm.token_counts import model_path

from .test_brute import plain_hits
from .test_near_sets import plain_least


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage and after the last, at a scale with labels enough to learn from."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        frames.append(docs)
    return [[r.asDict() for r in f.collect()] for f in frames]


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(spark, stages):
    for rows in stages[1:-1]:
        assert set(rows[0]) == set(corpus_pipeline.COLUMNS)
    assert set(stages[-1][0]) == {"doc_id", "n_tokens", "ids"}


def test_quality_keeps_clean_documents(stages):
    labels = dict(duckdb.sql("select doc_id, quality = 1 and toxic = 0 from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    kept = set(ids(stages[1]))
    clean = [d for d, good in labels.items() if good]
    bad = [d for d, good in labels.items() if not good]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_line_dedup_drops_only_recurring_lines(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[1:3])
    held = {}
    for t in after.values():
        for line in (t or "").split("\n"):
            held.setdefault(len(line.split()), []).append(line.split())
    same = lambda a, b: sum(x == y or any(c.isdigit() for c in x + y) for x, y in zip(a, b)) >= 0.6 * len(a)
    seen = {}
    for d, t in before.items():
        for line in set(t.split("\n")):
            seen.setdefault(line, set()).add(d)
    for d, t in before.items():
        gone = [x for x in t.split("\n") if x not in (after.get(d) or "").split("\n")]
        for line in gone:
            words = line.split()
            assert len(words) >= 5
            # one document keeps a line of the same template
            assert any(same(words, x) for x in held.get(len(words), ()))
    for line, of in seen.items():
        n = len(line.split())
        if len(of) >= (3 if n >= 50 else 8) and n >= 5:
            assert sum(line in (after.get(d) or "").split("\n") for d in of) <= 1


def test_near_dedup_keeps_one_of_each_group(stages):
    """By the rule for stages: five words, a share of 0.8 or more."""
    given = sorted((r["doc_id"], r["text"]) for r in stages[2])
    least = plain_least(given)
    assert len(set(least.values())) < len(given)
    assert ids(stages[3]) == sorted(set(least.values()))


def test_decontamination_drops_hits(stages):
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    hits = {d for d, _, n, _ in plain_hits([(r["doc_id"], r["text"]) for r in stages[3]], items) if n}
    assert hits and ids(stages[4]) == sorted(set(ids(stages[3])) - hits)


def test_encoding(stages):
    library = Tokenizer.from_file(model_path(bpe.MODEL))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert ids(stages[5]) == ids(stages[4])
    for r in stages[5]:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, want)) and r["n_tokens"] == len(want)


LONG = " ".join(f"w{i}" for i in range(40))
ODD = [(None, None), (None, ""), (None, LONG), (1, None), (1, LONG), (1, "another clean text of its own in some words"), (1, "another clean text of its own in some words"), (2, ""), (3, "x" * 20000), (4, LONG + " more")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, shared ids, repeated rows, a very long word, columns with clashing names."""
    rows = [(i, t, None, None, None, 1, "k", True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid int, _hash string, rejected boolean")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, name):
    sf, stage = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, sf)
    assert set(got.columns) == (set(corpus_pipeline.COLUMNS) if name != "encode" else {"doc_id", "n_tokens", "ids"})
    kept = sorted(got.collect(), key=repr)
    if name in ("line_dedup", "decontamination", "encode"):
        assert len(kept) == len(ODD)
    if name == "near_dedup":  # one null or empty text, one of the long ones, both equal rows
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept) == [
            (False, 0, ""), (False, 0, LONG), (True, 1, ODD[5][1]), (True, 1, ODD[5][1]), (True, 3, "x" * 20000)]
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    sf = "/root/testdata/sf0.001"
    item = duckdb.sql(f"select text from '{sf}/benchmark.parquet' order by length(text) desc limit 1").fetchall()[0][0]
    rows = [(7, item), (7, "clean text"), (None, item), (None, "clean too"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontamination(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "clean too"), (7, "clean text")]
