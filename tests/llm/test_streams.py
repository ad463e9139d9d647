"""Streamed encoding, lookahead and splices against the libraries on whole texts."""

import random
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import bpe, token_counts


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(token_counts.model_path(bpe.MODEL))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.model_path(bpe.MODEL))


def in_pieces(own, text, size):
    machine = bpe.Encoder(own)
    cut = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    return [i for at, p in enumerate(cut) for i in machine.feed(p, at == len(cut) - 1)]


PARTS = ["a", "th", "ing", " ", "\n", "É", "e", "́", "ΟΔΟΣ", "1", "!!", "'s", "'", "l", "ll", "<|endoftext|>", "<|", "endoftext", "|>", "€", "\x1c", "　", "ᄀ", "ᅡ", "ᆨ", "̈"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_any_cut_gives_the_same_ids(own, library, size):
    draw = random.Random(size)
    for _ in range(300):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(40)))
        assert in_pieces(own, text, size) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [500, 5000])
def test_words_without_end(own, library, size):
    draw = random.Random(size)
    texts = ["".join(draw.choice("etaoinshrdlu") for _ in range(9000)), "!?" * 4000, "é" * 9000, "x" * 20000, "a" * 9000 + "'ll" + "b" * 6000, "!" * 9000 + "'s" + "1" * 6000, "日本語" * 3000]
    for text in texts:
        assert in_pieces(own, text, size) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_small_merge_list():
    # b+c follows whether c goes to d first, and that whether d goes to e first
    assert bpe.sufficient_lookahead([("d", "e"), ("c", "d"), ("b", "c")]) == 3
    assert bpe.sufficient_lookahead([("b", "c"), ("c", "d"), ("d", "e")]) == 1
    assert bpe.sufficient_lookahead([("d", "e</w>"), ("c", "d")], "</w>") == 2


def test_a_boundary_beyond_the_lookahead_stays(own):
    """Ends of tokens that lie the lookahead before the end are ends in every continuation tried."""
    draw = random.Random(5)
    small = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("ba", "b"), ("aba", "ab"), ("b", "b")]
    own_rank, reach = own.rank, bpe.sufficient_lookahead(small)
    own.rank = {m: i for i, m in enumerate(small)}
    try:
        for _ in range(3000):
            whole = [draw.choice("ab") for _ in range(60)]
            part = whole[: draw.randrange(reach + 1, 60)]
            ends = lambda symbols: {sum(map(len, t[: i + 1])) for t in [own.merge(list(symbols))] for i in range(len(t))}
            assert {e for e in ends(part) if e <= len(part) - reach} <= ends(whole)
            assert own._merge_long(list(whole)) == own.merge(list(whole))
    finally:
        own.rank = own_rank


def test_memory_does_not_grow_with_the_text(own):
    def peak(n):
        texts = pa.array([("some words of a text " * 50 + "x" * 3000) * n])
        own.memo.clear()
        tracemalloc.start()
        bpe.coded(own, next(bpe.pieces(texts)), lambda s: None, lambda s: None)
        got = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got

    peak(1)
    assert peak(300) < 1.5 * peak(60) < 40 << 20


def test_words_merged_side_by_side(own):
    """As one by one: real words, and small merge lists full of ties."""
    draw = random.Random(11)
    words = ["".join(draw.choice(["a", "th", "ing", "É", "e\u0301", "日本", "1", "!!", "\x00", "x", "er", "on"]) for _ in range(draw.randrange(1, 12))) for _ in range(500)]
    words += ["a", "aa" * 20, "日" * 21]

    def one(machine, word):
        spelt = [machine.symbols[b] for b in word.encode()]
        spelt[-1] += machine.suffix
        return tuple(machine.vocab[t] for t in machine.merge(spelt))

    assert own.merger.merge(words) == [one(own, w) for w in words]
    assert own.merger.merge([]) == []
    lists = [[("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("ba", "b"), ("aba", "ab"), ("b", "b"), ("b", "a</w>")], [("a", "a"), ("aa", "aa"), ("a", "aa")], [("b", "a"), ("aba", "b"), ("a", "ba"), ("a", "b")], []]

    class Small:
        symbols, suffix, merge = own.symbols, "</w>", bpe.WordBPE.merge

    for merges in lists:
        small = Small()
        small.rank = {m: i for i, m in enumerate(merges)}
        names = [*own.symbols, *(x + "</w>" for x in own.symbols), *(a + b for a, b in merges)]
        small.vocab = {t: i for i, t in enumerate(dict.fromkeys(names))}
        words = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 30))) for _ in range(300)]
        assert bpe.Merger(small).merge(words) == [one(small, w) for w in words]


@pytest.mark.parametrize("memo,size", [(1 << 17, 100), (1 << 17, 3), (7, 40)])
def test_texts_coded_together(own, library, monkeypatch, memo, size):
    draw = random.Random(memo + size)
    texts = ["".join(draw.choice([*PARTS, "x" * 70, "日" * 30]) for _ in range(draw.randrange(60))) for _ in range(150)] + ["", "!?" * 4000, "a" * 9000 + "'ll", "a b " * 3000]
    monkeypatch.setattr(bpe, "MEMO", memo)
    own.memo.clear()
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda symbols: merged.append(len(symbols)) or merge(symbols))
    ids, decoded = [[] for _ in texts], [[] for _ in texts]
    cut = [[t[i : i + size] for i in range(0, len(t), size)] for t in texts]
    counts = bpe.coded_together(own, cut, [(i.append, d.append) for i, d in zip(ids, decoded)])
    for t, n, i, d in zip(texts, counts, ids, decoded):
        want = library.encode(t, add_special_tokens=False).ids
        assert n == len(want) and "".join(i) == " ".join(map(str, want)) and "".join(d) == library.decode(want, skip_special_tokens=False)
    # short words are not merged one by one
    assert min(merged, default=bpe.SIDE + 1) > bpe.SIDE
    assert len(own.memo) <= memo and max(map(len, own.memo), default=0) <= bpe.MEMO_CHARS


class SpacedModel:
    """A model whose pieces cross spaces: the longest piece first, from the left of each run that no piece crosses."""

    vocab = ["▁", "a", "b", "c", "a▁b", "b▁a▁b", "aa", "▁c▁"]

    def get_piece_size(self):
        return len(self.vocab)

    def id_to_piece(self, i):
        return self.vocab[i]

    def encode(self, text, out_type=int):
        spelt = ("▁" + text.replace(" ", "▁")) if text else ""
        tokens = list(spelt)
        while True:
            pairs = [(len(x + y), i) for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if x + y in self.vocab]
            triples = [(len(x + y + z), i) for i, (x, y, z) in enumerate(zip(tokens, tokens[1:], tokens[2:])) if x + y + z in self.vocab]
            if not pairs and not triples:
                break
            n, i = min(pairs + triples)
            size = 1
            while len("".join(tokens[i : i + size])) < n:
                size += 1
            tokens[i : i + size] = ["".join(tokens[i : i + size])]
        if out_type is int:
            return tokens
        at, offsets = -1, []
        for t in tokens:
            offsets.append((max(0, at), at + len(t)))
            at += len(t)
        return {"offsets": offsets}


@pytest.mark.parametrize("chunk,overlap", [(12, 2), (20, 3), (40, 8)])
def test_splices_widen_where_pieces_cross_spaces(chunk, overlap):
    model, draw = SpacedModel(), random.Random(chunk)
    count = token_counts.Counter(None, chunk, overlap, model)
    assert not count.marked
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", " ", "c", "a b", "b a b"]) for _ in range(draw.randrange(80)))
        assert count.count(text) == len(model.encode(text)), text
    assert count.widened > 0


def test_huge_texts_are_spliced_and_widened():
    path = token_counts.model_path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    count = token_counts.Counter(path, 64, 8)
    for text in ["y" * 2000, " " * 2000, ("y" * 500 + " ") * 3, "日本語" * 300, "one two " * 200]:
        assert count.count(text) == len(library.encode(text))
    assert count.widened > 0 and count.grown > 0
