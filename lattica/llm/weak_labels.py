r"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Two tasks are learnt the same way: low quality and toxicity.  For each, several
overlapping labellers vote on every document: against it (1), for it (0), or not
at all (-1).  The votes of the whole corpus are counted by pattern (a small
table: at most 3 to the number of labellers), and expectation-maximisation over
the patterns estimates how often each labeller votes which way on bad and on good
documents (the curated labels are one of them) and the share of bad documents.
The posterior of a document's pattern is its label; a linear scorer over hashed
features (words, their beginnings and shapes, and measures of the whole text) is
trained on a sample of at most ``sample`` documents, weighted so that both classes
count alike, and scores every document as a whole.

One labeller is the table of curated labels where it covers a document, and two
(for toxicity) are words and word beginnings mined from the curated labels:
frequent in documents labelled toxic and all but absent from the others.  Mining
and training read bounded samples (``sample`` rows, those with the smallest
seeded hash of their id); the driver gets the marks mined and the hashed features,
never texts.  Votes, counts and scores cover all documents.

Votes take texts one by one; scores take them in groups of bounded size (``GROUP``),
so that words new to a group are hashed side by side.  A worker holds the words of one
text or group and bounded memos (``MEMO`` words of at most 64 characters, and for scores
as many beginnings, and as many shapes, which thousands of words share).

Defined cases: null and empty texts are scored by their length alone (they are
of low quality); without labels the other labellers stand alone; repeated rows
each get their row; several labels of one id count as their majority (a tie as
bad); null ids never match a label; an empty table gives a scorer that rejects
nothing; other columns travel along, but for such as are named like the
operator's own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, tidy

TASKS = ("low_quality", "toxic")
#: Documents read to mine words, and to train, at most.
SAMPLE = 3000
BITS = 18
SEED = 42
#: Rejected from here on; a text without any known sign scores about one half, as both classes weigh alike.
THRESHOLD = 0.55
#: Share of the sample that must hold a bucket (three documents at least), and how telling it must be.
#: Quality shows in common signs, toxicity in rare words.
TRAINING = {"low_quality": (1 / 150, 1.0), "toxic": (0, 0.5)}
MEMO = 1 << 16
#: Texts, and their characters, that are scored together (a longer text is by itself), and words that are hashed at a time.
GROUP, GROUP_CHARS, HASHED = 64, 1 << 18, 1 << 13
_LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that serve as features.
STARTS = (4, 6)


# --- features -----------------------------------------------------------------


def starts_of(letters: str) -> list[str]:
    return [letters[:n] for n in STARTS if len(letters) > n]


def letters_of(word: str) -> list[str]:
    """The runs of letters of a word, in lower case."""
    word = word.lower()
    return [word] if word.isalpha() else _LETTERS.findall(word)


def word_features(word: str) -> list[str]:
    """The letters of a word, whole and their beginnings."""
    found = []
    for letters in letters_of(word):
        found.append("w:" + letters)
        for n in STARTS:
            if len(letters) > n:
                found.append(f"{n}:{letters[:n]}")
    return found


_SHAPE = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def features_of(word: str) -> list[str]:
    """All features of a word: its letters, their beginnings, and its shape (runs of a kind count once)."""
    if word.isalpha() and word.isascii():
        shape = "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else None
    else:
        shape = None
    found = word_features(word)
    found.append("s:" + (shape or _RUN.sub(r"\1", word[:64].translate(_SHAPE))))
    return found


class Measures:
    """What a text looks like: counts that labellers and features share."""

    def __init__(self, text: str) -> None:
        words = text.split()
        self.distinct = set(words)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256).tolist()
        n = max(1, len(words))
        up, low = sum(raw[65:91]), sum(raw[97:123])
        symbols = sum(raw[35:39]) + raw[42] + sum(raw[60:63]) + raw[64] + raw[92] + sum(raw[94:97]) + raw[126]
        self.symbols, self.exclaims, self.bars = symbols / n, raw[33] / n, raw[124] / n
        self.capitals = up / max(1, up + low)
        self.repeats = 1 - len(self.distinct) / n
        self.size = len(words)

    def features(self) -> list[str]:
        """Each measure in steps, and the size by powers of two."""
        found = [f"{k}={int(min(getattr(self, k), 1.0) * 20)}" for k in ("symbols", "exclaims", "bars", "capitals", "repeats")]
        found.append(f"size={min(8, int(math.log2(self.size + 1)))}")
        return found


def bucket(name: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), SEED) & ((1 << bits) - 1)


class Parts(dict):
    """The buckets of beginnings or shapes, -1 where they weigh nothing; remembered, as words have few of them."""

    def __init__(self, weighs: Callable[[str], int], name: Callable[[str], str]) -> None:
        self.weighs, self.name = weighs, name

    def __missing__(self, part: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[part] = self.weighs(self.name(part)) if part else -1
        return got


#: the kinds of characters below 128
_KINDS = np.array([ord(chr(c).translate(_SHAPE)) for c in range(128)], np.uint32)


def shapes_of(words: list[str]) -> list[str]:
    """The shapes of words (none of which holds a line break), as in ``features_of``."""
    codes = np.frombuffer("\n".join([w[:64] for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 128, _KINDS[np.minimum(codes, 127)], codes)
    first = np.append(True, kinds[1:] != kinds[:-1])
    return kinds[first].tobytes().decode("utf-32-le", "surrogatepass").split("\n")


class Scorer:
    """Hashed linear scorer: sums the weights of a text's distinct buckets for both tasks."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, bits: int) -> None:
        self.weights, self.bias, self.bits, self.mask = weights, bias, bits, (1 << bits) - 1
        #: both tasks' weights in one number, real part and imaginary part; most buckets weigh nothing
        self.both = {int(i): complex(*map(float, weights[:, i])) for i in np.flatnonzero(weights.any(axis=0))}
        self.heavy = weights.any(axis=0)
        self.memo: dict[str, tuple[int, ...]] = {}
        #: beginnings of different lengths never meet
        self.starts = Parts(self._weighs, lambda x: f"{len(x)}:{x}")
        self.shapes = Parts(self._weighs, lambda x: "s:" + x)

    def _weighs(self, name: str) -> int:
        at = bucket(name, self.bits)
        return at if self.heavy[at] else -1

    def buckets(self, words: list[str]) -> list[tuple[int, ...]]:
        """Of each word the buckets that weigh anything; the words are hashed side by side."""
        if not words:
            return []
        low = list(map(str.lower, words))
        word, whole = np.arange(len(words)), np.fromiter(map(str.isalpha, low), bool, len(low))
        # the runs of letters and whose they are, words of letters alone first
        each = list(map(_LETTERS.findall, compress(low, ~whole)))
        letters = [*compress(low, whole), *chain.from_iterable(each)]
        owner = np.concatenate([word[whole], np.repeat(word[~whole], np.fromiter(map(len, each), np.int64, len(each)))])
        names = [b"w:" + x.encode() for x in letters]
        at = np.fromiter(map(xxhash.xxh32_intdigest, names, repeat(SEED)), np.int64, len(names)) & self.mask
        found, of = [np.where(self.heavy[at], at, -1)], [owner]
        for n in STARTS:
            starts = [x[:n] if len(x) > n else "" for x in letters]
            found.append(np.fromiter(map(self.starts.__getitem__, starts), np.int64, len(starts)))
            of.append(owner)
        found.append(np.fromiter(map(self.shapes.__getitem__, shapes_of(words)), np.int64, len(words)))
        of.append(word)
        at, owner = np.concatenate(found), np.concatenate(of)
        at, owner = at[at >= 0], owner[at >= 0]
        at = at[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [tuple(at[a:b]) for a, b in zip([0, *ends], ends)]

    def word(self, word: str) -> tuple[int, ...]:
        """The buckets of a word that weigh anything."""
        return self.buckets([word])[0]

    def probabilities(self, text: str | None) -> tuple[float, float]:
        """(of low quality, toxic)"""
        return next(self.probabilities_of([text]))

    def probabilities_of(self, texts: Iterable[str | None]) -> Iterator[tuple[float, float]]:
        """The same of each text."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if group and (len(group) == GROUP or size + len(text) > GROUP_CHARS):
                yield from self._scored(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._scored(group)

    def _scored(self, texts: list[str]) -> Iterator[tuple[float, float]]:
        measures = [Measures(t) for t in texts]
        words = set().union(*(m.distinct for m in measures))
        fresh = words.difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = words
        fresh = list(fresh)
        for i in range(0, len(fresh), HASHED):
            part = fresh[i : i + HASHED]
            self.memo.update(zip(part, self.buckets(part)))
        own, bias = self.memo.__getitem__, complex(*map(float, self.bias))
        for m in measures:
            at = set(chain.from_iterable(map(own, m.distinct)))
            at.update(i for x in m.features() if (i := bucket(x, self.bits)) in self.both)
            score = sum(map(self.both.__getitem__, at), bias)
            yield tuple(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in (score.real, score.imag))
        for w in fresh:
            if len(w) > 64:
                del self.memo[w]
        if len(self.memo) > MEMO:
            self.memo.clear()


def buckets_of(text: str, bits: int) -> list[int]:
    """The distinct buckets of a text."""
    m = Measures(text)
    return list({bucket(x, bits) for x in m.features()}.union(bucket(x, bits) for w in m.distinct for x in features_of(w)))


def fit_linear(row: np.ndarray, at: np.ndarray, target: np.ndarray, bits: int, least: float = 0, strength: float = 0.5, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps over a sparse 0/1 matrix (row, bucket); both classes weigh alike.

    Columns are scaled by their smoothed log ratio between the classes, so that
    telling buckets learn first; those of fewer than a share
    ``least`` of the documents (and than three), or
    whose log ratio is within ``strength``, keep weight zero.
    target: the posterior of being bad.
    """
    weights = np.zeros(1 << bits, np.float32)
    if not len(target) or target.max() < 0.5 or target.min() > 0.5:
        return weights, 10.0 if len(target) and target.min() > 0.5 else -10.0
    share = target.mean()
    n_bad = np.bincount(at, target[row], 1 << bits)
    n_good = np.bincount(at, minlength=1 << bits) - n_bad
    ratio = np.log((n_bad + 2 * share) / (n_good + 2 * (1 - share)) * (1 - share) / share)
    use = np.flatnonzero((n_bad + n_good >= max(3, least * len(target))) & (np.abs(ratio) > strength))
    place = np.full(1 << bits, -1, np.int32)
    place[use] = np.arange(len(use), dtype=np.int32)
    col = place[at]
    row, col = row[col >= 0], col[col >= 0]
    value = ratio[use][col]
    each = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    # a step that a Hessian of this norm allows
    norm = np.bincount(row, value**2, len(target))
    step = 4.0 / (1.0 + (norm * each).sum())
    w, moved = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    for _ in range(rounds):
        score = np.bincount(row, value * w[col], len(target)) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) * each
        grad = np.append(np.bincount(col, value * off[row], len(use)), off.sum())
        moved = 0.9 * moved - step * grad
        w += moved
    weights[use] = w[:-1] * ratio[use]
    return weights, float(w[-1])


# --- labellers ------------------------------------------------------------------

QUALITY_LABELLERS = ("empty", "symbols", "capitals", "exclaims", "bars", "repeats", "plain", "curated")
TOXIC_LABELLERS = ("mined_words", "mined_starts", "density", "curated")
#: Those that vote both ways; that they are silent says nothing.
TWO_SIDED = {"mined_words", "mined_starts", "density", "curated"}
#: Labellers that look at the same words count less each, as they err together.
VOICE = {"mined_words": 0.5, "mined_starts": 0.5, "density": 0.5}
#: How often a labeller is believed to be right before the votes are seen; that weighs as much as its votes.
BELIEF = {"curated": 0.998}


def quality_votes(m: Measures) -> list[int]:
    """1: low quality, 0: good, -1: no vote.  Each of the middle ones knows one sign of it; the last vouches for plain texts."""
    grades = [(m.symbols, 0.05, 0.4), (m.capitals, 0.15, 0.5), (m.exclaims, 0.02, 0.3), (m.bars, 0.02, 0.3), (m.repeats, 0.6, 0.8)]
    plain = m.size > 0 and all(x <= good for x, good, _ in grades)
    return [-1 if m.size else 1, *(1 if m.size and x >= bad else -1 for x, _, bad in grades), 0 if plain else -1]


def marks_of(counts: dict[str, tuple[int, int]], n_bad: int, n_good: int, least: int = 3) -> tuple[set[str], set[str]]:
    """(words, word beginnings) that mark documents labelled toxic; counts: documents of either kind that hold a feature."""
    marks = {name for name, (bad, good) in counts.items() if bad >= least and bad / n_bad >= 20 * (good + 0.5) / max(1, n_good)}
    return {x[2:] for x in marks if x[0] == "w"}, {x[2:] for x in marks if x[0] != "w"}


class Marks:
    """Looks for mined words and beginnings; remembers words that hold none."""

    def __init__(self, words: set[str], starts: set[str]) -> None:
        self.words, self.starts = words, starts
        self.either = words | starts
        self.clean: set[str] = set()

    def count(self, word: str) -> tuple[int, int]:
        """(mined words, mined beginnings) among a word's letters."""
        marked = begun = 0
        for letters in letters_of(word):
            marked += letters in self.words
            begun += any(x in self.starts for x in starts_of(letters))
        return marked, begun

    def count_all(self, words: set[str]) -> tuple[int, int]:
        """The same over distinct words; all but a few are ruled out at sight."""
        short, long = STARTS
        either, runs = self.either, _LETTERS.findall
        fresh, held = words.difference(self.clean), []
        for word in fresh:
            low = word.lower()
            if low.isalpha():
                if low in either or low[:short] in either or low[:long] in either:
                    held.append(word)
            else:
                for x in runs(low):
                    if x in either or x[:short] in either or x[:long] in either:
                        held.append(word)
                        break
        if len(self.clean) + len(fresh) > MEMO:
            self.clean.clear()
        fresh.difference_update(held)
        if len(fresh) <= MEMO:
            self.clean.update([w for w in fresh if len(w) <= 64])
        got = [self.count(w) for w in held]
        return sum(x for x, _ in got), sum(x for _, x in got)


def toxic_votes(m: Measures, marks: Marks) -> list[int]:
    if not marks.words and not marks.starts:
        return [-1, -1, -1]
    marked, begun = marks.count_all(m.distinct)
    share = (marked + begun) / max(1, len(m.distinct))
    return [1 if marked >= 2 else 0 if not marked else -1, 1 if begun >= 2 else 0 if not begun else -1, 1 if share >= 0.02 else 0 if share < 0.002 else -1]


# --- the weak-label model -----------------------------------------------------------


class LabelModel:
    """Labellers' habits, the share of bad documents and the posterior of vote patterns, by expectation-maximisation.

    Each labeller votes for itself, given the class: its outcomes are 1 and 0
    (where it votes) for one that votes both ways, and -1, 0, 1 for one that
    knows a single sign, whose silence speaks too.  The start takes any vote
    against a document as a hint, which settles which class is which.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, labellers: tuple[str, ...], rounds: int = 100) -> None:
        """votes: patterns by labellers of 1, 0, -1; counts: documents of each."""
        self.voices = [VOICE.get(x, 1.0) for x in labellers]
        p = np.where((votes == 1).any(axis=1), 0.95, 0.02)
        for _ in range(rounds):
            #: the share of bad documents
            self.prior = float((p * counts).sum() / counts.sum())
            self.prior = min(max(self.prior, 1e-4), 1 - 1e-4)
            #: of each labeller: the chance of each outcome on bad and on good documents
            self.habits = []
            for v, name in zip(votes.T, labellers):
                outcomes = (0, 1) if name in TWO_SIDED else (-1, 0, 1)
                seen = np.array([[(q * counts)[v == o].sum() for o in outcomes] for q in (p, 1 - p)])
                before = np.full(seen.shape, 0.5)
                if name in BELIEF:
                    before += seen.sum(axis=1, keepdims=True) * [[1 - BELIEF[name], BELIEF[name]], [BELIEF[name], 1 - BELIEF[name]]]
                seen += before
                self.habits.append(dict(zip(outcomes, (seen / seen.sum(axis=1, keepdims=True)).T.tolist())))
            p = self.posterior(votes)

    @property
    def accuracy(self) -> list[float]:
        """How often each labeller is right where it votes."""
        found = []
        for habit in self.habits:
            right = self.prior * habit[1][0] + (1 - self.prior) * habit[0][1]
            found.append(right / (right + self.prior * habit[0][0] + (1 - self.prior) * habit[1][1]))
        return found

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of being bad of each pattern."""
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for v, habit, voice in zip(votes.T, self.habits, self.voices):
            for outcome, (bad, good) in habit.items():
                odds[v == outcome] += voice * math.log(bad / good)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


# --- the operator --------------------------------------------------------------------


def _curated(labels: DataFrame) -> DataFrame:
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of"))
    worst = lambda good: F.when(F.count(good) > 0, F.when(F.avg(good) > 0.5, 1).otherwise(0))
    return per.agg(
        (1 - worst(F.col("quality"))).alias("low_quality"), (1 - worst(1 - F.col("toxic"))).alias("toxic")
    ).where("low_quality is not null or toxic is not null")


def _sampled(docs: DataFrame, n: int, sample: int) -> DataFrame:
    """The ``sample`` rows with the smallest seeded hash of their id."""
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 1)
    share = 1.2 * sample / max(1, n)
    if share < 1:  # spares the sort most rows
        docs = docs.where(chance < int(share * 2**53) << 10)
    return docs.orderBy(chance, "id").limit(sample)


class Classifier:
    """Both tasks' scorers and what the weak-label models found."""

    def __init__(self, scorer: Scorer, models: dict[str, LabelModel | None], words: set[str], starts: set[str]) -> None:
        self.scorer, self.models, self.words, self.starts = scorer, models, words, starts


def _mined(known: DataFrame) -> tuple[set[str], set[str]]:
    """Marks of the toxic rows among ``known`` (t, toxic); rows are counted by feature where they are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = Counter(), Counter()
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                (bad if toxic else good).update({x for w in set(t.as_py().split()) for x in word_features(w)} | {""})
            names = list(bad | good)
            arrays = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (bad, good))]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "bad", "good"])

    counts = known.mapInArrow(tidy(count), "name string, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts.where("name = '' or bad > 0"))
    total = counts.where("name = ''").first()
    if total is None or not total.bad:
        return set(), set()
    share = F.col("bad") / total.bad >= 20 * (F.col("good") + 0.5) / max(1, total.good)
    kept = counts.where((F.col("name") != "") & (F.col("bad") >= 3) & share).collect()
    return marks_of({r.name: (r.bad, r.good) for r in kept}, total.bad, total.good)


def fit(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> Classifier:
    """Votes and counts over all of ``docs``; words mined and weights trained on at most ``sample`` rows each."""
    with scratch():
        return _fitted(docs, labels, doc_id, text, sample, bits)


def _fitted(docs: DataFrame, labels: DataFrame | None, doc_id: str, text: str, sample: int, bits: int) -> Classifier:
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    spark = docs.sparkSession
    if labels is None:
        curated = spark.range(0).select(F.col("id").alias("of"), F.lit(0).alias("low_quality"), F.lit(0).alias("toxic"))
    else:
        curated = _curated(labels)
    curated = materialize(curated)
    n_labels = curated.count()
    ids = _sampled(curated.select(F.col("of").alias("id"), "toxic").where("toxic is not null"), n_labels, sample)
    words, starts = _mined(rows.join(F.broadcast(ids), "id").select("t", "toxic").limit(sample))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(words, starts)
        for batch in batches:
            q, x = [], []
            for t in batch.column(1):
                m = Measures(t.as_py())
                q.append("".join("01-"[v] for v in quality_votes(m)))
                x.append("".join("01-"[v] for v in toxic_votes(m, marks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, pa.string()), pa.array(x, pa.string())], ["id", "q", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    votes = rows.mapInArrow(tidy(vote), f"id {kind}, q string, x string")
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    votes = votes.join(curated, votes.id == curated.of, "left").select(
        "id", F.concat("q", mark("low_quality")).alias("low_quality"), F.concat("x", mark("toxic")).alias("toxic")
    )
    votes = materialize(votes)
    n = votes.count()
    models: dict[str, LabelModel | None] = {}
    tables = {}
    for task, labellers in zip(TASKS, (QUALITY_LABELLERS, TOXIC_LABELLERS)):
        got = votes.groupBy(task).count().collect()  # at most 3 ** 8 rows
        patterns = np.array([["01-".index(c) if c != "-" else -1 for c in r[0]] for r in got])
        models[task] = LabelModel(patterns, np.array([r[1] for r in got], float), labellers) if got else None
        tables[task] = dict(zip((r[0] for r in got), models[task].posterior(patterns))) if got else {}
    chosen = _sampled(votes, n, sample)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([buckets_of(t.as_py(), bits) for t in part.column(0)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), made], ["low_quality", "toxic", "at"])

    train = rows.join(F.broadcast(chosen), "id").limit(sample).select("t", "low_quality", "toxic")
    got = train.mapInArrow(tidy(featurize), "low_quality string, toxic string, at array<int>").toArrow()
    weights, bias = np.zeros((2, 1 << bits), np.float32), np.zeros(2)
    if got.num_rows:
        held = got.column("at").combine_chunks()
        sizes = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False)
        row, at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), held.flatten().to_numpy(zero_copy_only=False)
        del held
        for i, task in enumerate(TASKS):
            target = np.array([tables[task][v] for v in got.column(task).to_pylist()])
            weights[i], bias[i] = fit_linear(row, at, target, bits, *TRAINING[task])
    else:
        bias[:] = -10.0
    return Classifier(Scorer(weights, bias, bits), models, words, starts)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and rejected."""
    own = ["p_low_quality", "p_toxic", "rejected"]
    docs = docs.drop(*own)
    scorer, bits = classifier.scorer, classifier.scorer.bits
    held = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(*held.value, bits)
        for batch in batches:
            got = list(mine.probabilities_of(t.as_py() for t in batch.column(at)))
            bad = [max(x) >= threshold for x in got]
            arrays = [*batch.columns, pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, p_low_quality double, p_toxic double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "rejected")
