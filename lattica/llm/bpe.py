r"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Encoding follows the tokenizer file's own steps: special tokens are cut out,
white space and case are normalised, words are split off, and each word's bytes
are merged by rank.  A text is read in pieces (``PIECE`` bytes of its buffer), and
every word goes through the transducer, which holds the symbols whose tokens may
still change.  The transducers of a group of texts run side by side: their words that are
not remembered are merged together, one merge of each word at a time (``Merger``).

``sufficient_lookahead`` computes from the merge list how far to the right of a
place the decision to merge across it can depend on the text.  A merge (u, v)
depends on what follows v only where an earlier merge takes the right edge of v
(v itself or the last part of its making) together with what follows, and that
merge in turn on still earlier ones; the longest such chain is the bound.  So an
end of a token that lies so many symbols before the end of what has been read
is an end of a token in any continuation; and as merges on both sides of such an
end are independent, the tokens before it are emitted and their symbols
forgotten.  A word's end makes all its tokens stable.  Memory depends on the
merge list (and on a bounded memo of words that went through, and a group's pieces), not on the text;
only a run of combining marks without any base character is held whole.

Decoding is the reverse machine: ids become bytes, one table entry each, and an
incremental UTF-8 decoder turns them into text, holding at most the three bytes
of an unfinished character.  The bytes are either those of the token strings
joined by spaces, as the tokenizer's own decode gives them when its file names no
decoder, or (``readable``) those that the tokens stand for.

Defined cases: null counts as empty, which has no tokens; strings of special
tokens inside a text become these tokens, as the library does by default;
repeated rows keep their row, null ids stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MODEL = "word_bpe_49k.json"
#: Bytes of a text read at a time.
PIECE = 1 << 16
#: Words remembered, and their greatest length; characters of one word that are held before it is streamed.
MEMO, MEMO_CHARS, LONG = 1 << 17, 48, 1 << 12
#: Texts that are encoded side by side; words that are merged at a time, and their greatest length in symbols.
GROUP, MERGED, SIDE = 64, 1 << 13, 64
#: Unicode's white space.
_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols after a place that can decide whether a merge crosses it.

    reach[u]: the most that the merges so far with left part u depend on, from
    the end of u.  Merges come by rank, so that only earlier ones are chained.
    """
    length = lambda t: len(t.removesuffix(suffix)) if suffix and t != suffix else len(t)
    edges: dict[str, set[str]] = {}
    reach: dict[str, int] = {}
    most = 1
    for left, right in merges:
        ends_word = bool(suffix) and right.endswith(suffix)
        beyond = 0 if ends_word else max(reach.get(x, 0) for x in edges.get(right, {right}))
        own = length(right) + beyond
        reach[left] = max(reach.get(left, 0), own)
        most = max(most, own)
        edges.setdefault(left + right, {left + right}).update(edges.get(right, {right}))
    return most


@cache
def _second_parts() -> frozenset[str]:
    """Characters that canonical composition may join to one before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _starts_anew(c: str) -> bool:
    """Whether canonical composition treats what comes before this character by itself."""
    if c.isascii():
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _second_parts()


class WordBPE:
    """The tokenizer of a file: normalise, split, merge."""

    def __init__(self, path: str, window: int | None = None) -> None:
        """window: symbols of one word that are merged at a time, twice the lookahead if not given."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.window = max(window or 0, 2 * self.lookahead)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.surface = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        pattern = pattern.replace(r"\s", _SPACES)
        self.words = regex.compile(pattern)
        #: the same for ASCII texts in lower case
        self.plain_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        #: the kinds of words without an end
        self.runs = [regex.compile(p) for p in pattern.split("|") if p.endswith("+")]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.id_texts = [str(i) for i in range(max(self.surface) + 1)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.merger = Merger(self)

    def normalise(self, text: str) -> str:
        """Composed and in lower case; runs of white space stay, as no word holds any."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # characters one by one: no final form of sigma
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a normalised text."""
        return (self.plain_words if text.isascii() else self.words).findall(text)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of least rank, the leftmost first, until none is left."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs."""
        rank, n = self.rank, len(symbols)
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p is not None]

    def learn(self, words: list[str]) -> None:
        """Put the tokens of words that went through the transducer into the memo."""
        short = []
        for w in words:
            if len(w) <= SIDE and len(w.encode()) <= SIDE:
                short.append(w)
            else:
                self.memo[w] = Encoder(self).word(w)
        for i in range(0, len(short), MERGED):
            part = short[i : i + MERGED]
            self.memo.update(zip(part, self.merger.merge(part)))

    def ids(self, texts: list[list[int | list[str]]]) -> list[list[int]]:
        """The ids of what encoders gave (ids, and lists of words), text by text."""
        words = set().union(*(x for parts in texts for x in parts if type(x) is list))
        fresh = words.difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = words
        self.learn(list(fresh))
        own, found = self.memo.__getitem__, []
        for parts in texts:
            out: list[int] = []
            for x in parts:
                if type(x) is list:
                    out.extend(chain.from_iterable(map(own, x)))
                else:
                    out.append(x)
            found.append(out)
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return found

    def encode(self, text: str | None) -> list[int]:
        return Encoder(self).feed(text or "", True)

    def decode(self, ids: Iterable[int], readable: bool = False) -> str:
        return "".join(self.to_text(ids, readable))

    def to_text(self, ids: Iterable[int], readable: bool = True) -> Iterator[str]:
        """The decoded text piece by piece, one id at a time."""
        machine = Decoder(self, readable)
        for i in ids:
            yield machine.feed([i])
        yield machine.close()


class Merger:
    """Merges many words side by side: in each round every word's pair of least rank, its leftmost, until no word has any."""

    def __init__(self, bpe: WordBPE) -> None:
        number: dict[str, int] = {}
        of = lambda t: number.setdefault(t, len(number))
        #: the numbers of a byte's symbol, and of the same at the end of a word
        self.symbol = np.array([of(x) for x in bpe.symbols])
        self.final = np.array([of(x + bpe.suffix) for x in bpe.symbols])
        pairs = [(of(a), of(b), of(a + b)) for a, b in bpe.rank]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        rank = np.fromiter(bpe.rank.values(), np.int64, len(pairs))
        #: the number of what a merge makes, by rank
        self.made = np.zeros(max(rank, default=0) + 1, np.int64)
        self.made[rank] = made
        #: the rank of no merge
        self.none = len(self.made)
        self.token = {i: bpe.vocab[t] for t, i in number.items() if t in bpe.vocab}
        #: pairs in a table with open addresses, at most a quarter full
        self.width = len(number)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        key = left * self.width + right
        at = self._place(key)
        while len(key):
            # the first comer takes a free place, the others move on
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.ranks[at[first]] = key[first], rank[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank, at = key[rest], rank[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, ``none`` for such as do not merge."""
        key = left * self.width + right
        at = self._place(key)
        there = self.keys[at]
        found = np.where(there == key, self.ranks[at], self.none)
        more = np.flatnonzero((there != key) & (there != -1))
        while len(more):
            at[more] = at[more] + 1 & (1 << self.bits) - 1
            there = self.keys[at[more]]
            same = there == key[more]
            found[more[same]] = self.ranks[at[more[same]]]
            more = more[~same & (there != -1)]
        return found

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word; none is empty."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        last = np.cumsum(size) - 1
        part = self.symbol[flat]
        part[last] = self.final[flat[last]]
        #: of each symbol the rank of it and the next one
        rank = np.append(self.rank(part[:-1], part[1:]), self.none)
        rank[last] = self.none
        word, done = np.arange(len(words)), []
        while len(word):
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begin)
            live = least < self.none
            if not live.all():
                on = np.repeat(live, size)
                done.append((word[~live], size[~live], part[~on]))
                word, size, least, part, rank = word[live], size[live], least[live], part[on], rank[on]
                if not len(word):
                    break
                begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(word)), size)
            at = np.flatnonzero(rank == least[owner])
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            part[at] = self.made[least]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            end = at + 2 == begin + size
            rank[at] = self.none
            inner = at[~end]
            before = at[at > begin]
            both = self.rank(np.concatenate([part[inner], part[before - 1]]), np.concatenate([part[inner + 2], part[before]]))
            rank[inner], rank[before - 1] = both[: len(inner)], both[len(inner) :]
            part, rank, size = part[keep], rank[keep], size - 1
        if not done:
            return []
        word, size, part = map(np.concatenate, zip(*done))
        ids = list(map(self.token.__getitem__, part.tolist()))
        ends = np.cumsum(size).tolist()
        found: list[tuple[int, ...]] = [()] * len(words)
        for i, a, b in zip(word.tolist(), [0, *ends], ends):
            found[i] = tuple(ids[a:b])
        return found


class Encoder:
    """The transducer of one text: pieces of it go in, ids come out as soon as they are stable."""

    def __init__(self, bpe: WordBPE) -> None:
        self.bpe = bpe
        #: raw text that may be part of a special token or change under normalisation; normalised text whose word may go on
        self.raw, self.tail = "", ""
        #: the kind and the unstable symbols of a long word that is open
        self.run, self.symbols = None, []

    def feed(self, text: str, last: bool = False) -> list[int]:
        """The ids that have become stable; all that are left if this piece is the last."""
        return self.bpe.ids([self.parts(text, last)])[0]

    def parts(self, text: str, last: bool = False) -> list[int | list[str]]:
        """The same as ids, and lists of whole words whose ids ``WordBPE.ids`` gives."""
        bpe, out = self.bpe, []
        raw = self.raw + text
        parts = bpe.cut.split(raw) if bpe.cut else [raw]
        for i, part in enumerate(parts[:-1]):
            if i % 2:
                out.append(bpe.special[part])
            elif part:
                self._words(part, True, out)
            elif self.tail or self.run:
                self._words("", True, out)
        rest = parts[-1]
        upto = len(rest) if last else self._settled(rest)
        self.raw = rest[upto:]
        self._words(rest[:upto], last, out)
        return out

    def _settled(self, text: str) -> int:
        """How much of a text cannot change by what follows it."""
        upto = len(text)
        while upto and not _starts_anew(text[upto - 1]):
            upto -= 1
        upto = max(0, upto - 1)
        for special in self.bpe.special:
            for size in range(min(len(special) - 1, len(text)), 0, -1):
                if text.endswith(special[:size]):
                    upto = min(upto, len(text) - size)
                    break
        # the place found for a special token must leave whole characters before it
        while upto and upto < len(text) and not _starts_anew(text[upto]):
            upto -= 1
        return upto

    def _words(self, text: str, end: bool, out: list[int | list[str]]) -> None:
        """Ids of the words of normalised pieces; ``end``: no word goes on after them."""
        bpe = self.bpe
        text = self.tail + bpe.normalise(text)
        self.tail = ""
        if self.run:
            got = self.run.match(text)
            n = got.end() if got else 0
            self._push(text[:n], out)
            if n == len(text) and not end:
                return
            self._finish(out)
            text = text[n:]
        if not end:
            cut = len(text)
            while cut and text[cut - 1] not in _SPACES:
                cut -= 1
            self.tail, text = text[cut:], text[:cut]
        if words := bpe.split(text):
            out.append(words)
        if len(self.tail) > LONG:
            self._long(out)

    def _long(self, out: list[int | list[str]]) -> None:
        """A tail without a space: its complete words, and the beginning of one that goes on."""
        text, done, whole = self.tail, 0, []
        for m in self.bpe.words.finditer(text):
            # the other kinds of words have at most three characters
            if m.end() > len(text) - 3 and not (m.end() - m.start() > 3 and m.end() < len(text)):
                break
            whole.append(m[0])
            done = m.end()
        out.append(whole)
        self.tail = text = text[done:]
        if len(text) > LONG:
            self.run = next(r for r in self.bpe.runs if r.match(text))
            self.tail = ""
            self._push(text, out)

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one whole word."""
        out: list[int] = []
        self._push(word, out)
        self._finish(out)
        return tuple(out)

    def _push(self, chars: str, out: list[int]) -> None:
        """Symbols of a word go in; tokens that nothing can change any more come out."""
        bpe = self.bpe
        spelt = [bpe.symbols[b] for b in chars.encode()]
        for at in range(0, len(spelt), bpe.window):
            self.symbols += spelt[at : at + bpe.window]
            if len(self.symbols) <= bpe.window:
                continue
            stable = len(self.symbols) - bpe.lookahead
            done = 0
            for token in bpe.merge(list(self.symbols)):
                if done + len(token) > stable:
                    break
                done += len(token)
                out.append(bpe.vocab[token])
            self.symbols = self.symbols[done:]

    def _finish(self, out: list[int]) -> None:
        if self.symbols:
            self.symbols[-1] += self.bpe.suffix
            out.extend(map(self.bpe.vocab.__getitem__, self.bpe.merge(self.symbols)))
        self.symbols, self.run = [], None


class Decoder:
    """The reverse machine: ids go in, bytes pass through, text comes out."""

    def __init__(self, bpe: WordBPE, readable: bool = False) -> None:
        self.table, self.between = _tables(bpe, readable)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.between.join(map(self.table.__getitem__, ids))
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


def _tables(bpe: WordBPE, readable: bool) -> tuple[list[bytes], bytes]:
    """The bytes of each id, and those between two ids."""
    name = f"_table_{readable}"
    if not hasattr(bpe, name):
        special = set(bpe.special.values())
        back = {s: b for b, s in enumerate(bpe.symbols)}
        table = [b""] * len(bpe.id_texts)
        for i, token in bpe.surface.items():
            if not readable or i in special:
                table[i] = token.encode()
            else:
                ends = bool(bpe.suffix) and token.endswith(bpe.suffix)
                table[i] = bytes(back[s] for s in (token.removesuffix(bpe.suffix) if ends else token)) + b" " * ends
        setattr(bpe, name, table)
    return getattr(bpe, name), b"" if readable else b" "


@cache
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Iterator[str]]:
    """Each text of an array as pieces of at most ``size`` bytes, straight from its buffer; null as none."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    data = memoryview(texts.buffers()[2] or b"")

    def cut(a: int, b: int) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")()
        for at in range(a, b, size):
            yield state.decode(data[at : min(b, at + size)], at + size >= b)

    null = texts.is_null().to_pylist()
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if null[i] or a == b:
            yield iter(())
        elif b - a <= size:
            yield iter((str(data[a:b], "utf-8"),))
        else:
            yield cut(a, b)


def coded(bpe: WordBPE, text: Iterable[str], on_ids: Callable[[str], object], on_text: Callable[[str], object]) -> int:
    """Run both machines over one text; gives each piece of the ids (joined by spaces) and of the decoded text away, returns the number of tokens."""
    return coded_together(bpe, [text], [(on_ids, on_text)])[0]


def coded_together(bpe: WordBPE, texts: list[Iterable[str]], sinks: list[tuple[Callable[[str], object], Callable[[str], object]]]) -> list[int]:
    """The same over several texts side by side, a piece of each at a time."""
    machines = [(Encoder(bpe), Decoder(bpe)) for _ in texts]
    held, n = [iter(t) for t in texts], [0] * len(texts)
    piece = {i: next(h, "") for i, h in enumerate(held)}
    while piece:
        following = {i: next(held[i], None) for i in piece}
        parts = [machines[i][0].parts(p, following[i] is None) for i, p in piece.items()]
        for i, ids in zip(piece, bpe.ids(parts)):
            decoder, (on_ids, on_text) = machines[i][1], sinks[i]
            if ids:
                on_ids((" " if n[i] else "") + " ".join(map(bpe.id_texts.__getitem__, ids)))
                on_text(decoder.feed(ids))
                n[i] += len(ids)
            if following[i] is None:
                on_text(decoder.close())
        piece = {i: p for i, p in following.items() if p is not None}
    return n


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces), decoded (as the library decodes these)."""

    def sink() -> tuple:
        ids: list[str] = []
        decoded: list[str] = []
        return ids.append, decoded.append, lambda: ("".join(ids), "".join(decoded))

    return _mapped(docs, doc_id, text, model, sink, "ids string, decoded string")


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ``ids`` and ``decoded`` of :func:`encode`, taken piece by piece."""

    def sink() -> tuple:
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        return lambda s: ids.update(s.encode()), lambda s: decoded.update(s.encode()), lambda: (ids.hexdigest(), decoded.hexdigest())

    return _mapped(docs, doc_id, text, model, sink, "ids_sha256 string, decoded_sha256 string")


def _mapped(docs, doc_id, text, model, sink, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_counts import model_path

        bpe = tokenizer(model_path(model))
        for batch in batches:
            got, texts = [], pieces(batch.column(1))
            while group := list(islice(texts, GROUP)):
                sinks = [sink() for _ in group]
                counts = coded_together(bpe, group, [s[:2] for s in sinks])
                got += [(n, *s[2]()) for n, s in zip(counts, sinks)]
            made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)
        bpe.memo.clear()

    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["id", "n_tokens", *(c.split(" ")[0] for c in columns.split(", "))]
    made = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), f"id {kind}, n_tokens long, {columns}")
    return made.withColumnRenamed("id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_digests(table(spark, sf_dir, "documents"))
