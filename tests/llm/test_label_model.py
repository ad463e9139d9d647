"""Votes, the label model and mining against plain versions."""

import random
from collections import Counter

import numpy as np

from lattica.llm import weak_labels as W


def plain_votes(text):
    words = text.split()
    n = len(words)
    each = lambda chars: sum(text.count(c) for c in chars) / max(1, n)
    up, low = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    signs = [each("#$%&*<=>@\\^_`~"), up / max(1, up + low), each("!"), each("|"), 1 - len(set(words)) / max(1, n)]
    high, fine = (0.4, 0.5, 0.3, 0.3, 0.8), (0.05, 0.15, 0.02, 0.02, 0.6)
    bad = [1 if n and x >= h else -1 for x, h in zip(signs, high)]
    return [1 if not n else -1, *bad, 0 if n and all(x <= f for x, f in zip(signs, fine)) else -1]


def test_votes():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice(["word", " ", " ", "A", "#", "|", "!", "é", "\n", "the "]) for _ in range(draw.randrange(60)))
        assert W.quality_votes(W.Measures(text)) == plain_votes(text), text
    marks = W.Marks({"scum", "fool"}, {"stup"})
    for text, want in [("you scum, FOOL!", [1, 0, 1]), ("scum and many other words " + " ".join(map(str, range(300))), [-1, 0, -1]), ("stupid stupor", [0, 1, 1]), ("kind words", [0, 0, 0]), ("", [0, 0, 0])]:
        assert W.toxic_votes(W.Measures(text), marks) == want
        assert W.toxic_votes(W.Measures(text), marks) == want  # from the memo
    assert W.toxic_votes(W.Measures("scum"), W.Marks(set(), set())) == [-1, -1, -1]


def test_model_recovers_habits_and_share(monkeypatch):
    draw = np.random.default_rng(3)
    n, share = 40000, 0.2
    bad = draw.random(n) < share
    right = [0.95, 0.85, 0.8]
    votes = [np.where(draw.random(n) < 0.7, np.where(draw.random(n) < r, bad, ~bad), -1) for r in right]
    votes.append(np.where(bad & (draw.random(n) < 0.6), 1, -1))  # knows one sign only
    counted = Counter(map(tuple, np.array(votes, int).T.tolist()))
    patterns, counts = np.array(list(counted)), np.array(list(counted.values()), float)
    monkeypatch.setattr(W, "TWO_SIDED", {"a", "b", "c"})
    model = W.LabelModel(patterns, counts, ("a", "b", "c", "d"))
    assert abs(model.prior - share) < 0.02
    assert all(abs(a - r) < 0.02 for a, r in zip(model.accuracy, right))
    assert abs(model.habits[3][1][0] - 0.6) < 0.05 and model.habits[3][1][1] < 0.01
    # the posterior is Bayes' rule over the habits
    for pattern, got in zip(patterns, model.posterior(patterns)):
        x, y = model.prior, 1 - model.prior
        for vote, habit in zip(pattern, model.habits):
            b, g = habit.get(int(vote), (1, 1))
            x, y = x * b, y * g
        assert abs(got - x / (x + y)) < 1e-9


def test_mined_marks(spark):
    texts = [("you scum go away now", 1)] * 4 + [("scum of all", 1)] + [("nice day of all", 0)] * 60
    got = W._mined(spark.createDataFrame(texts, "t string, toxic int"))
    counts = {}
    for t, toxic in texts:
        for name in {x for w in t.split() for x in W.word_features(w)}:
            b, g = counts.get(name, (0, 0))
            counts[name] = (b + toxic, g + 1 - toxic)
    assert got == W.marks_of(counts, 5, 60) and "scum" in got[0] and "all" not in got[0]
    assert W._mined(spark.createDataFrame([], "t string, toxic int")) == (set(), set())


def test_scores_are_sums():
    draw = np.random.default_rng(2)
    weights = draw.normal(size=(2, 1 << 10)).astype(np.float32)
    scorer = W.Scorer(weights, np.array([0.1, -0.2]), 10)
    for text in ["Some words, and some MORE words!", "", "x " * 50, "a|b|c 123"]:
        m = W.Measures(text)
        at = {W.bucket(x, 10) for x in m.features() + [x for w in m.distinct for x in W.features_of(w)]}
        assert at == set(W.buckets_of(text, 10))
        want = [sum(float(weights[i, b]) for b in at) + (0.1, -0.2)[i] for i in (0, 1)]
        for got, z in zip(scorer.probabilities(text), want):
            assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_words_that_share_beginnings_and_shapes_are_hashed_once_each(monkeypatch):
    rng = np.random.default_rng(5)
    weights = np.zeros((2, 1 << 12), np.float32)
    weights[:, rng.choice(1 << 12, 900, replace=False)] = rng.normal(size=(2, 900))
    words = [f"{a}{b}{c}" for a in ("prefix", "Straße", "x9-$", "AB", "") for b in "abcdefgh" for c in ("", "q", "RR,", "long" * 20)]
    scorer = W.Scorer(weights, np.zeros(2), 12)
    calls = []
    own = W.xxhash.xxh32_intdigest
    monkeypatch.setattr(W.xxhash, "xxh32_intdigest", lambda *x: calls.append(x) or own(*x))
    got = [scorer.word(w) for w in words]
    # whole letters each, beginnings and shapes once
    parts = {x for w in words for x in W.features_of(w) if x[0] != "w"}
    assert len(calls) <= sum(x[0] == "w" for w in words for x in W.features_of(w)) + 3 * len(parts)
    monkeypatch.undo()
    want = [[at for x in W.features_of(w) if (at := W.bucket(x, 12)) in scorer.both] for w in words]
    assert list(map(sorted, got)) == list(map(sorted, want)) and any(want)


def test_words_of_a_group_are_hashed_side_by_side(monkeypatch):
    draw, rng = random.Random(7), np.random.default_rng(7)
    words = ["Straße", "İx-Y", "x9-$", "ABab", "a-a", "²x", "日本", "--", "\ud800z", "e\u0301", "q" * 70, "Zz1" * 30, *(f"w{i}" for i in range(50))]
    texts = [None, "", *(" ".join(draw.choice(words) for _ in range(draw.randrange(40))) for _ in range(300))]
    weights = np.where(rng.random((2, 1 << 10)) < 0.5, rng.normal(size=(2, 1 << 10)), 0).astype(np.float32)
    plain = []
    for text in texts:
        m = W.Measures(text or "")
        at = {W.bucket(x, 10) for x in m.features() + [x for w in m.distinct for x in W.features_of(w)]}
        plain.append([1 / (1 + np.exp(-sum(float(weights[i, b]) for b in at))) for i in (0, 1)])
    for memo, group, chars in ((1 << 16, 64, 1 << 18), (40, 64, 1 << 18), (5, 7, 300), (1, 1, 1)):
        for name, value in (("MEMO", memo), ("GROUP", group), ("GROUP_CHARS", chars), ("HASHED", max(2, memo // 3))):
            monkeypatch.setattr(W, name, value)
        scorer, calls = W.Scorer(weights, np.zeros(2), 10), []
        own = scorer.buckets
        monkeypatch.setattr(scorer, "buckets", lambda words: calls.append(len(words)) or own(words))
        assert np.allclose(list(scorer.probabilities_of(iter(texts))), plain, atol=1e-9)
        assert len(scorer.memo) <= memo and max(map(len, scorer.memo), default=0) <= 64
        # new words go in groups, not text by text
        assert memo < 1000 or len(calls) <= len(texts) // group + 1


def test_words_without_marks_are_ruled_out_at_sight(monkeypatch):
    draw = random.Random(8)
    letters = ["scum", "Scums", "scummy", "stup", "stupid", "stupidly", "fool-scum", "x1stupor", "İscum", "kind", "k" * 70, *(f"w{i}x" for i in range(60))]
    for memo in (1 << 16, 5):
        monkeypatch.setattr(W, "MEMO", memo)
        marks, counted = W.Marks({"scum", "fool", "w"}, {"stup", "stupid"}), []
        own = marks.count
        monkeypatch.setattr(marks, "count", lambda w: counted.append(w) or own(w))
        for _ in range(200):
            words = {draw.choice(letters) for _ in range(draw.randrange(30))}
            want = [0, 0]
            for x in (x for w in words for x in W.letters_of(w)):
                want[0] += x in marks.words
                want[1] += any(s in marks.starts for s in W.starts_of(x))
            assert marks.count_all(words) == tuple(want)
            assert len(marks.clean) <= memo
        assert not {"kind", "k" * 70} & set(counted)
