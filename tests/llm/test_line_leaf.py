"""A template's lines meet however many others lie between them in the leaf."""

import random

import pyarrow as pa
import pytest

from lattica.llm import line_templates as L


def lines(others):
    draw = random.Random(others)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    tail = "and this is the same for all"
    same = [f"please read our terms {word()} {tail}" for _ in range(40)]
    return same, [" ".join(["please read our terms", *(word() for _ in range(8))]) for _ in range(others)]


@pytest.mark.parametrize("others", [0, 100, 1000, 5000])
def test_one_template_in_a_leaf(others):
    same, rest = lines(others)
    tree = L.Tree(L.SIMILARITY, L.LONG_WORDS, L.LONG_DOCS, L.SHORT_DOCS)
    found = []
    for doc, text in enumerate(sorted(same + rest)):
        words = L.masked(text)
        found += tree.push(L.leaf_of(words, L.DEPTH), text, L.number(text), [doc])
    found += tree.flush()
    assert {line for line, *_ in found} == {L.number(t) for t in same}
    assert len({first for _, first, _ in found}) == 1


def test_blocks_find_what_all_comparisons_find():
    draw = random.Random(4)
    texts = sorted({" ".join(["a", "b", "c", "d", *(draw.choice("xyz") for _ in range(draw.choice([1, 2, 6, 11])))]) for _ in range(3000)}, key=lambda t: (len(t), t))
    tree = L.Tree(L.SIMILARITY, 50, 1, 1)
    plain: dict[int, list] = {}
    for i, t in enumerate(texts):
        words = t.split(" ")
        list(tree.push(len(words), t, i, [i]))
        leaf = plain.setdefault(len(words), [])
        hit = next((x for x in reversed(leaf) if x.agrees(words, L.SIMILARITY)), None)
        if hit is None:
            leaf.append(hit := L.Template(words))
        hit.add(words, i, [i], 1)
        assert [x.lines for x in tree.held] == [x.lines for x in leaf]


def test_documents_keep_one_line_of_a_scattered_template(spark):
    same, rest = lines(300)
    given = list(enumerate(same + rest))
    got = {r.doc_id for r in L.dedup_lines(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got == {0, *range(40, 340)}


def test_decided_lines_come_in_bounded_batches(spark, monkeypatch):
    """Each line brings its template's text, which together have no bound."""
    found = []
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: found.append(f) or own(self, f, schema))
    L.templates(docs)
    monkeypatch.setattr(L, "HELD", 4096)
    words = [" ".join(["same"] * 60 + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}"]) for i in range(300)]
    columns = [pa.array([7] * 300), pa.array(words), pa.array(range(300)), pa.array([[i] for i in range(300)], pa.list_(pa.int64()))]
    got = list(found[-1](iter([pa.RecordBatch.from_arrays(columns, ["leaf", "words", "line", "docs"])])))
    assert sum(([*b.column(0).to_pylist()] for b in got), []) == list(range(300))
    assert {x for b in got for x in b.column(1).to_pylist()} == {0}
    assert max(sum(map(len, b.column(2).to_pylist())) for b in got) <= 4096 + 400
