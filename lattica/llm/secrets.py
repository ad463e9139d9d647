r"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: a walk
over the parsed pattern gives the strings that every match must hold, an
alternation becomes OR, a sequence AND, and a literal run its trigrams (folded
to lower case).  Each Arrow batch of documents is indexed in one pass: trigrams
that some rule asks for are looked up in a table over the batch's whole text
buffer and turned into postings.  The queries intersect and unite postings, and
only candidates are scanned by the expression itself.  A rule without a
mandatory trigram (the hex rule) scans every text.

Defined cases: null counts as empty; spans are code points, end exclusive;
letters of a key word match in either ASCII case; repeated rows keep their row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Strings kept of one sub-expression, and their greatest length, before the walk gives up on exactness.
EXACT, LENGTH = 16, 24

ALL = ("all",)


def _and(parts):
    flat = tuple(dict.fromkeys(q for p in parts if p != ALL for q in (p[1] if p[0] == "and" else (p,))))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts):
    parts = tuple(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _literal(text: str):
    """The query of a text that must occur: all its trigrams."""
    folded = text.lower()
    if not folded.isascii():
        return ALL
    return _and([("tri", folded[i : i + 3]) for i in range(len(folded) - 2)])


def _walk(parsed) -> tuple[set[str] | None, tuple]:
    """(the strings it can match, if they are few; what each match must hold)."""
    held, need = {""}, []

    def close():
        nonlocal held
        need.append(_or([_literal(x) for x in held]))
        held = {""}

    for op, arg in parsed:
        if op is K.LITERAL:
            some, must = {chr(arg)}, ALL
        elif op is K.SUBPATTERN:
            some, must = _walk(arg[3])
        elif op is K.BRANCH:
            each = [_walk(x) for x in arg[1]]
            some = None if any(x is None for x, _ in each) else set().union(*(x for x, _ in each))
            must = _or([q if x is None else _or([_literal(y) for y in x]) for x, q in each])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            part, must = _walk(inner)
            if (low, high) == (0, 1) and part is not None:
                some, must = part | {""}, ALL
            elif (low, high) == (1, 1):
                some = part
            else:
                some, must = None, must if low else ALL
        elif op is K.IN and all(x is K.LITERAL for x, _ in arg):
            some, must = {chr(x) for _, x in arg}, ALL
        else:
            some, must = None, ALL
        joined = None if some is None else {x + y for x in held for y in some}
        if joined is not None and len(joined) <= EXACT and max(map(len, joined)) <= LENGTH:
            held = joined
        else:
            close()
            need.append(must)
            if some is not None and len(some) <= EXACT:
                held = some
    if not any(q != ALL for q in need):
        return held if _plain(parsed, held) else None, _or([_literal(x) for x in held])
    close()
    return None, _and(need)


def _plain(parsed, held: set[str]) -> bool:
    """Whether ``held`` is all that the pattern matches."""
    simple = (K.LITERAL, K.SUBPATTERN, K.BRANCH, K.MAX_REPEAT, K.IN)
    for op, arg in parsed:
        if op not in simple:
            return False
        if op is K.MAX_REPEAT and arg[:2] not in ((0, 1), (1, 1)):
            return False
        if op is K.IN and not all(x is K.LITERAL for x, _ in arg):
            return False
        if op is K.SUBPATTERN and not _plain(arg[3], held):
            return False
        if op is K.BRANCH and not all(_plain(x, held) for x in arg[1]):
            return False
    return True


def trigram_query(pattern: str) -> tuple:
    """("all",), ("tri", abc), ("and", parts) or ("or", parts): what each match must hold, in lower case."""
    return _walk(_parser.parse(pattern, re.ASCII))[1]


def trigrams(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams(q) for q in query[1])) if query[0] in ("and", "or") else set()


class TrigramIndex:
    """Postings of the wanted trigrams over a batch of texts."""

    def __init__(self, wanted: set[str]) -> None:
        self.wanted = sorted(wanted)
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The sorted places of texts that hold each wanted trigram."""
        found = {t: [] for t in self.wanted}
        base = texts.offset
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], kind)[base : base + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        if data is None or not len(texts):
            return {t: np.zeros(0, np.int64) for t in self.wanted}
        raw = np.frombuffer(data, np.uint8)
        piece = 1 << 20
        for at in range(int(ends[0]), int(ends[-1]), piece):
            part = self.fold[raw[at : min(at + piece + 2, int(ends[-1]))]].astype(np.uint32)
            got = self.number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]] if len(part) > 2 else np.zeros(0, np.uint16)
            hit = np.flatnonzero(got)
            place = hit + at
            doc = np.searchsorted(ends, place, "right") - 1
            inside = place + 3 <= ends[doc + 1]
            which = got[hit]
            for i in np.unique(which[inside]):
                found[self.wanted[i - 1]].append(doc[inside & (which == i)])
        return {t: np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for t, x in found.items()}


def candidates(query: tuple, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query[0] == "all":
        return np.arange(n)
    if query[0] == "tri":
        return postings[query[1]]
    parts = [candidates(q, postings, n) for q in query[1]]
    out = parts[0]
    for x in parts[1:]:
        out = np.intersect1d(out, x, True) if query[0] == "and" else np.union1d(out, x)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each row, by start, then the rules' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = TrigramIndex(set().union(*map(trigrams, queries)))
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            postings = index.postings(texts)
            strings = texts.to_pylist()
            spans: list[list] = [[] for _ in strings]
            for number, (rule, query, regex) in enumerate(zip(rules, queries, compiled)):
                for i in candidates(query, postings, len(strings)).tolist():
                    for m in regex.finditer(strings[i] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[i].append((m.start(), number, m.end()))
            named = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, kind)], ["id", "spans"])

    of = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(
        run, f"id {of}, spans array<struct<kind:string,start:long,end:long>>"
    )
    return found.select(F.col("id").alias(doc_id), "spans")


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined_spans(spans).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    line = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    return found.select("doc_id", *(count(r.kind) for r in RULES), line.alias("spans")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"
    )
