"""Full-text search: vectors of lexemes with positions, queries, ranks and headlines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()
#: A small stop list for the English configuration.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Endings that the light stemmer takes off, the longest first, where three letters stay.
ENDINGS = ("ingly", "edly", "ing", "ies", "ed", "ly", "es", "s")
WORD = r"[\p{L}\p{N}]+"


def stem(w: Column) -> Column:
    out = w
    for e in reversed(ENDINGS):
        cut = F.substr(w, F.lit(1), F.length(w) - len(e))
        out = F.when(F.endswith(w, F.lit(e)) & (F.length(w) > len(e) + 2), cut if e != "ies" else F.concat(cut, F.lit("y"))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case words in order, stop words kept as empty texts so that positions stand."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.when(w.isin(*STOP), "").otherwise(w))


def to_tsvector(text: Column, config: str = "english") -> Column:
    """array of struct(lexeme, position) in order of position, positions from 1."""
    lexeme = stem if config == "english" else lambda w: w
    held = F.transform(tokens(text), lambda w, i: F.struct(lexeme(w).alias("lexeme"), (i + 1).alias("position")))
    return F.filter(held, lambda x: x.lexeme != "")


def lexemes(v: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(v, lambda x: x.lexeme)))


class Query:
    """Parsed query: & | ! <-> <N> and parentheses; a leaf is a lexeme, possibly with :* for a prefix."""

    def __init__(self, tree) -> None:
        self.tree = tree

    @staticmethod
    def parse(text: str) -> Query:
        found = re.findall(r"<->|<\d+>|[&|!()]|[\w']+(?::\*)?", text)
        at = 0

        def level(ops, below):
            nonlocal at
            left = below()
            while at < len(found) and ops(found[at]):
                op = found[at]
                at += 1
                left = (op, left, below())
            return left

        def either():
            return level(lambda t: t == "|", both)

        def both():
            return level(lambda t: t == "&", phrase)

        def phrase():
            return level(lambda t: t.startswith("<"), one)

        def one():
            nonlocal at
            t = found[at]
            at += 1
            if t == "!":
                return ("!", one())
            if t == "(":
                inner = either()
                at += 1
                return inner
            return ("lexeme", t)

        return Query(either())

    @staticmethod
    def plain(text: str) -> Query:
        words = [w for w in re.findall(r"\w+", text.lower()) if w not in STOP]
        return Query(reduce(lambda a, b: ("&", a, b), [("lexeme", w) for w in words]))

    @staticmethod
    def phrase(text: str) -> Query:
        words = [w for w in re.findall(r"\w+", text.lower()) if w not in STOP]
        return Query(reduce(lambda a, b: ("<->", a, b), [("lexeme", w) for w in words]))

    @staticmethod
    def web(text: str) -> Query:
        """Quoted phrases, or, and -word."""
        out, joined = None, "&"
        for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if word.lower() == "or":
                joined = "|"
                continue
            part = (Query.phrase(quoted) if quoted else Query.plain(word)).tree
            part = ("!", part) if minus else part
            out = part if out is None else (joined, out, part)
            joined = "&"
        return Query(out)

    def __and__(self, other: Query) -> Query:
        return Query(("&", self.tree, other.tree))

    def __or__(self, other: Query) -> Query:
        return Query(("|", self.tree, other.tree))

    def __invert__(self) -> Query:
        return Query(("!", self.tree))

    def leaves(self) -> list[str]:
        walk = lambda t: [t[1]] if t[0] == "lexeme" else [x for s in t[1:] for x in walk(s)]
        return walk(self.tree)

    def rewrite(self, old: str, new: Query) -> Query:
        """Replace a lexeme by a query."""
        walk = lambda t: new.tree if t == ("lexeme", old) else t if t[0] == "lexeme" else (t[0], *map(walk, t[1:]))
        return Query(walk(self.tree))


def _is(x: Column, leaf: str) -> Column:
    if leaf.endswith(":*"):
        return F.startswith(x, F.lit(leaf[:-2].lower()))
    return x == stem(F.lit(leaf.lower()))


def matches(v: Column, query: Query) -> Column:
    def positions(t) -> Column:
        """Where a phrase operand ends."""
        if t[0] == "lexeme":
            return F.transform(F.filter(v, lambda x: _is(x.lexeme, t[1])), lambda x: x.position)
        gap = 1 if t[0] == "<->" else int(t[0][1:-1])
        left, right = positions(t[1]), positions(t[2])
        return F.filter(right, lambda p: F.array_contains(left, p - gap))

    def go(t) -> Column:
        if t[0] == "lexeme":
            return F.exists(v, lambda x: _is(x.lexeme, t[1]))
        if t[0] == "!":
            return ~go(t[1])
        if t[0] == "&":
            return go(t[1]) & go(t[2])
        if t[0] == "|":
            return go(t[1]) | go(t[2])
        return F.size(positions(t)) > 0

    return go(query.tree)


def rank(v: Column, query: Query) -> Column:
    """Sum over the query's lexemes of 0.1 weighed down by the occurrence's number, then normalised."""
    weigh = lambda leaf: F.aggregate(F.transform(F.filter(v, lambda x: _is(x.lexeme, leaf)), lambda x, i: F.lit(0.1) / F.pow(i + 1, F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    leaves = query.leaves()
    return reduce(lambda a, b: a + b, map(weigh, leaves)) / (len(leaves) * 1.64493406685)


def headline(text: Column, query: Query, start: str = "<b>", stop: str = "</b>") -> Column:
    words = "|".join(re.escape(x.removesuffix(":*")) + (r"\w*" if x.endswith(":*") else "") for x in query.leaves())
    return F.regexp_replace(text, rf"(?i)\b({words})\b", f"{start}$1{stop}")


def delete(v: Column, *words: str) -> Column:
    return F.filter(v, lambda x: ~x.lexeme.isin(*words))


def strip(v: Column) -> Column:
    return lexemes(v)


def synonym(text: Column, table: dict[str, str]) -> Column:
    """Replace words by their synonyms before lexemes are made."""
    held = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.coalesce(F.try_element_at(held, w), w)), " ")


@R.frame(
    "F_text_match",
    r"""SELECT doc_id, list_contains(w, 'the') AND list_contains(w, 'of') AS both_, len(list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'the')) > 0 AS phrase_
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""",
)
def _match(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    v = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position")))
    rows = t.documents.select("doc_id", v.alias("v"))
    both, phrase = Query.parse("the & of"), Query.parse("in <-> the")
    return rows.select("doc_id", matches(F.col("v"), both).alias("both_"), matches(F.col("v"), phrase).alias("phrase_"))


@R.frame("F_text_vector", None)
def _vector(t):
    v = to_tsvector(F.col("text"))
    return t.benchmark.select("item_id", F.size(lexemes(v)).alias("n"), F.round(rank(v, Query.parse("ing:* | that")), 9).alias("r"))


@R.frame("F_text_headline", None)
def _headline(t):
    return t.benchmark.select("item_id", headline(F.col("text"), Query.parse("the | of")).alias("h"))
