r"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of words, then by its
leading words (words with a digit count as the field ``<*>``).  In the leaf it
joins a template that agrees in at least ``similarity`` of all places, the
places that differ become fields, or else starts one.  A template that occurs in
enough documents is boilerplate: its lines are dropped from every document but
the one with the smallest id, so that nothing is lost from the corpus.  Lines of
``long_words`` or more need ``long_docs`` documents, others ``short_docs``;
lines under ``min_words`` are never dropped.  A document left without lines that
had some is dropped.

Each map task first unites equal lines (``HELD`` bytes of them at a time), with
their count limited to the smallest ``short_docs`` document ids that the decision
needs, so a line that a third of all documents share reaches the leaf's task once
for each map task.  Leaves are parsed as streams in the order of their lines.  A
line is compared with all templates of its leaf that may agree: the places after
the leading words are cut into one block more than places may differ, so that a
template that agrees has one block in full.  The newest template that agrees takes
the line.

A leaf with more than ``leaf_lines`` united lines is split by further words: each
line goes to one smaller leaf for each of its blocks, named by the words there.  A
template's lines agree in all places but its fields, which leave one block at least
untouched, so that they all meet in that block's leaf.  A line found in several
of them is kept by the smallest of the documents named.  A task holds the templates
of one leaf and the hashes of their lines.

Defined cases: null and empty texts have no lines and stay as they are; rows
that share an id count as one document, null ids likewise; line ends are ``\n``;
an empty table gives no rows; all other columns travel along, but for such as
are named like the operator's own.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, tidy

DEPTH, SIMILARITY = 4, 0.8
MIN_WORDS, LONG_WORDS = 5, 50
SHORT_DOCS, LONG_DOCS = 8, 3
#: Characters of distinct lines united at a time.
HELD = 1 << 24
#: Lines of a leaf that is not split.
LEAF_LINES = 1 << 17
FIELD = "<*>"
_DIGIT = re.compile(r"[0-9]")


def masked(line: str) -> list[str]:
    """The line's words, fields for those with a digit."""
    words = line.split()
    return [FIELD if _DIGIT.search(w) else w for w in words] if _DIGIT.search(line) else words


def number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def line_hash(line: str, min_words: int) -> int | None:
    """What tells a masked line from others, None if the line is too short."""
    words = masked(line)
    return number(" ".join(words)) if len(words) >= min_words else None


def leaf_of(words: list[str], depth: int) -> int:
    return number(str(len(words)), *words[:depth])


def blocks_of(words: list[str], depth: int, similarity: float) -> list[tuple]:
    """The blocks of a line or template; those that agree share one at least."""
    n, parts = len(words), int((1 - similarity) * len(words)) + 1
    start = min(depth, n)
    cuts = [start + (n - start) * i // parts for i in range(parts + 1)]
    return [(i, *words[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


class Template:
    __slots__ = ("words", "docs", "lines")

    def __init__(self, words: list[str]) -> None:
        self.words, self.docs, self.lines = words, set(), []

    def agrees(self, words: list[str], similarity: float) -> bool:
        most = (1 - similarity) * len(words)
        differ = 0
        for a, b in zip(self.words, words):
            if a != b and a != FIELD:
                differ += 1
                if differ > most:
                    return False
        # fields of earlier lines count as differences too, or a template would drift
        return differ + sum(a == FIELD and b != FIELD for a, b in zip(self.words, words)) <= most

    def add(self, words: list[str], line: int, docs: list, keep: int) -> None:
        if self.lines:
            self.words = [a if a == b else FIELD for a, b in zip(self.words, words)]
        self.docs.update(docs)
        if len(self.docs) > keep:
            self.docs = set(nsmallest(keep, self.docs, key=_order))
        self.lines.append(line)


def _order(doc):
    return (doc is not None, doc)


class Tree:
    """Templates of leaves that come one after another."""

    def __init__(self, similarity: float, long_words: int, long_docs: int, short_docs: int, depth: int = DEPTH) -> None:
        self.similarity, self.long_words, self.long_docs, self.short_docs = similarity, long_words, long_docs, short_docs
        self.depth = depth
        self.leaf, self.held, self.blocks = None, [], {}

    def _index(self, at: int, known: set[tuple]) -> None:
        """Keys of a template; those of former words stay: what they find is compared all the same."""
        for k in blocks_of(self.held[at].words, self.depth, self.similarity):
            if k not in known:
                insort(self.blocks.setdefault(k, []), at)

    def _close(self, templates: list[Template]) -> Iterator[tuple]:
        for t in templates:
            need = self.long_docs if len(t.words) >= self.long_words else self.short_docs
            if len(t.docs) >= need:
                first = min(t.docs, key=_order)
                words = " ".join(t.words)
                for line in t.lines:
                    yield line, first, words

    def push(self, leaf: int, text: str, line: int, docs: list) -> Iterator[tuple]:
        """(line, first document, template) of what is decided by now."""
        keep = max(self.long_docs, self.short_docs)
        if leaf != self.leaf:
            yield from self.flush()
            self.leaf = leaf
        words = text.split(" ")
        if not self.held:  # most leaves have one line
            self.held.append(Template(words))
            self.held[0].add(words, line, docs, keep)
            return
        if not self.blocks:
            self._index(0, set())
        tried = set()
        best = -1
        for k in blocks_of(words, self.depth, self.similarity):
            for at in reversed(self.blocks.get(k, ())):
                if at <= best:
                    break
                if at not in tried:
                    tried.add(at)
                    if self.held[at].agrees(words, self.similarity):
                        best = at
        known: set[tuple] = set()
        if best < 0:
            best = len(self.held)
            self.held.append(Template(words))
        else:
            known = set(blocks_of(self.held[best].words, self.depth, self.similarity))
        self.held[best].add(words, line, docs, keep)
        self._index(best, known)

    def flush(self) -> Iterator[tuple]:
        yield from self._close(self.held)
        self.held, self.blocks = [], {}


def templates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    long_words: int = LONG_WORDS,
    short_docs: int = SHORT_DOCS,
    long_docs: int = LONG_DOCS,
    leaf_lines: int = LEAF_LINES,
) -> DataFrame:
    """(line, first, template): hashes of lines to drop, and the document that keeps them."""
    keep = max(short_docs, long_docs)
    id_type = docs.schema[doc_id].dataType
    united = T.StructType(
        [
            T.StructField("leaf", T.LongType()), T.StructField("words", T.StringType()),
            T.StructField("line", T.LongType()), T.StructField("docs", T.ArrayType(id_type)),
        ]
    )
    decided = T.StructType(
        [T.StructField("line", T.LongType()), T.StructField("first", id_type), T.StructField("template", T.StringType())]
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            leaves, lines = [], []
            for k in held:
                leaves.append(leaf_of(k.split(" "), depth))
                lines.append(number(k))
            columns = [pa.array(leaves, pa.int64()), pa.array(held.keys(), pa.string()), pa.array(lines, pa.int64()), pa.array(held.values(), ids)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["leaf", "words", "line", "docs"])

        for batch in batches:
            ids = pa.list_(batch.schema.field(0).type)
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in (t or "").split("\n"):
                    words = masked(line)
                    if len(words) < min_words:
                        continue
                    key = " ".join(words)
                    seen = held.get(key)
                    if seen is None:
                        held[key] = [doc]
                        size += len(key)
                    elif doc not in seen:
                        seen.append(doc)
                        if len(seen) > 4 * keep:
                            seen[:] = nsmallest(keep, seen, key=_order)
                    if size >= HELD:
                        yield out()
                        size = 0
        if held:
            yield out()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(similarity, long_words, long_docs, short_docs, depth)
        ids = None
        before: list | None = None
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*rows))
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], ids), pa.array(cols[2], pa.string())], ["line", "first", "template"]
            )

        def bounded(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            """Full batches of what is found: each line brings its template's text."""
            nonlocal size
            for row in found:
                rows.append(row)
                size += len(row[2])
                if size >= HELD:
                    yield made()

        for batch in batches:
            ids = batch.schema.field(3).type.value_type
            for leaf, words, line, of in zip(*(c.to_pylist() for c in batch.columns)):
                # equal lines of several map tasks follow each other
                if before is not None and before[2] == line and before[0] == leaf:
                    before[3] = nsmallest(keep, set(before[3]).union(of), key=_order)
                    continue
                if before is not None:
                    yield from bounded(tree.push(*before))
                before = [leaf, words, line, of]
            if rows:
                yield made()
        if before is not None:
            yield from bounded(tree.push(*before))
            yield from bounded(tree.flush())
            if rows:
                yield made()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                keys = blocks_of(one.column(1)[0].as_py().split(" "), depth, similarity)
                leaves = [number(str(one.column(0)[0].as_py()), *map(str, k)) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves, pa.int64()), *(c.take(pa.array([0] * len(leaves))) for c in one.columns[1:])], batch.schema.names
                )

    lines = materialize(docs.select(doc_id, text).mapInArrow(tidy(unite), united))
    crowded = materialize(lines.groupBy("leaf").count().where(F.col("count") > leaf_lines).select("leaf"))
    parsed = lambda df: df.repartition("leaf").sortWithinPartitions("leaf", "words").mapInArrow(tidy(parse), decided)
    if crowded.isEmpty():
        return parsed(lines)
    # there are fewer crowded leaves than lines by leaf_lines times
    split = lines.join(crowded, "leaf", "left_semi").select(*united.names).mapInArrow(tidy(deal), united)
    both = parsed(lines.join(crowded, "leaf", "left_anti").select(*united.names).unionAll(split))
    return both.groupBy("line").agg(F.min(F.struct(F.col("first").isNotNull().alias("known"), "first", "template")).alias("x")).select("line", "x.first", "x.template")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the cleaned text, n_lines and n_dropped; a document that loses all its lines is left out."""
    docs = docs.drop("n_lines", "n_dropped", "_drop")
    min_words = limits.get("min_words", MIN_WORDS)
    id_type = docs.schema[doc_id].dataType

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lines = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for line in (t or "").split("\n") if (h := line_hash(line, min_words)) is not None}
                of.extend([doc] * len(own))
                lines.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(of, batch.schema.field(0).type), pa.array(lines, pa.int64())], ["of", "line"])

    in_docs = docs.select(doc_id, text).mapInArrow(tidy(hashes), T.StructType([T.StructField("of", id_type), T.StructField("line", T.LongType())]))
    # both joins are merges at every size: neither side has a bound
    with scratch() as own:
        found = materialize(templates(docs, doc_id, text, **limits))
        hit = in_docs.join(found.select("line", "first").hint("merge"), "line").where(~F.col("of").eqNullSafe(F.col("first")))
        drops = own.keep(materialize(hit.groupBy("of").agg(F.collect_set("line").alias("_drop"))))
    names = docs.columns
    marked = docs.join(drops.hint("merge"), docs[doc_id].eqNullSafe(drops["of"]), "left").select(*(docs[c] for c in names), "_drop")
    at, at_drop = names.index(text), len(names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = batch.column(at).to_pylist(), batch.column(at_drop).to_pylist()
            n_lines, n_dropped, keep = [], [], []
            for i, t in enumerate(texts):
                lines = t.split("\n") if t else []
                if drop[i]:
                    gone = set(drop[i])
                    left = [x for x in lines if line_hash(x, min_words) not in gone]
                    texts[i] = "\n".join(left)
                else:
                    left = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                keep.append(not lines or any(x.strip() for x in left) or len(left) == len(lines))
            columns = [c if i != at else pa.array(texts, batch.schema.field(at).type) for i, c in enumerate(batch.columns[:at_drop])]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"]).filter(pa.array(keep))

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return marked.mapInArrow(tidy(clean), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
