"""Line dedup on whole tables against a plain tree, crowded leaves, long lines."""

import random

import pytest

from lattica.llm import line_templates as L

from .test_brute import texts


def plain_drops(given, similarity=L.SIMILARITY):
    """{line: first document}: every line against all templates of its leaf, the newest first."""
    seen = {}
    for d, t in given:
        for line in (t or "").split("\n"):
            words = L.masked(line)
            if len(words) >= L.MIN_WORDS:
                seen.setdefault(tuple(words), set()).add(d)
    leaves = {}
    for words in sorted(seen, key=lambda w: " ".join(w).encode()):
        held = leaves.setdefault((len(words), words[: L.DEPTH]), [])
        for t in reversed(held):
            if sum(a != b for a, b in zip(t[0], words)) <= (1 - similarity) * len(words):
                break
        else:
            held.append(t := [list(words), set(), []])
        t[0] = [a if a == b else L.FIELD for a, b in zip(t[0], words)]
        t[1] |= seen[words]
        t[2].append(words)
    out = {}
    for held in leaves.values():
        for _, docs, lines in held:
            if len(docs) >= (L.LONG_DOCS if len(lines[0]) >= L.LONG_WORDS else L.SHORT_DOCS):
                out |= {L.number(" ".join(w)): min(docs) for w in lines}
    return out


@pytest.fixture(scope="module")
def crowd():
    """Texts of sf0.01, and a leaf with hundreds of templates among which recurring ones are scattered."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    given = texts("/root/testdata/sf0.01")
    n = max(d for d, _ in given) + 1
    head = "please read our terms"
    given += [(n + i, " ".join([head, *(word() for _ in range(9))])) for i in range(400)]
    bodies = [[word() for _ in range(9)] for _ in range(5)]
    for i in range(60):
        body = list(bodies[i % 5])
        body[draw.randrange(9)] = word()
        given.append((n + 400 + i, " ".join([head, *body])))
    return given


def test_whole_table_with_crowded_leaves(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    got = {r.line: r.first for r in L.templates(df).collect()}
    want = plain_drops(crowd)
    assert len(want) > 60 and got == want
    after = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    for d, t in crowd:
        lines = t.split("\n")
        kept = [x for x in lines if (h := L.line_hash(x, L.MIN_WORDS)) not in want or want[h] == d]
        if any(x.strip() for x in kept) or len(kept) == len(lines):
            assert after[d] == "\n".join(kept)
        else:
            assert d not in after


@pytest.mark.parametrize("leaf_lines", [20, 100])
def test_split_leaves_find_the_same_lines(spark, crowd, leaf_lines):
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    got = {r.line: r.first for r in L.templates(df, leaf_lines=leaf_lines).collect()}
    want = plain_drops(crowd)
    assert set(want) <= set(got) and len(got) <= 1.02 * len(want)


def test_very_long_lines(spark):
    long = " ".join(f"w{chr(97 + i % 26)}" for i in range(60000))
    given = [(i, long + ("" if i < 3 else f" end{chr(97 + i)}")) for i in range(5)] + [(9, "x" * 300000)]
    got = {r.doc_id: r.n_dropped for r in L.dedup_lines(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got == {0: 0, 3: 0, 4: 0, 9: 0}
