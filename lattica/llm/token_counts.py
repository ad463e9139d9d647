"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than ``chunk`` characters is encoded by the library in chunks that
overlap, each with the offsets of its tokens.  Two neighbouring encodings are
spliced at a token boundary that both have inside their overlap and that is proven
stable: no piece of the vocabulary lies across it in the text.  Merges only make
pieces of the vocabulary, so nothing is ever merged across such a place,
whatever stands around it, and the tokens on its two sides are those of the whole
text.  If the overlap holds none, it is widened (doubled) and the next chunk
encoded again; if even the whole open chunk holds none, that chunk grows.  So
the sum equals the count for the whole text, in the memory of one chunk unless a
text goes on for longer without any such place.

Shorter texts are no huge ones: the library encodes them whole.

Assumed of the model, as of the one used: its normaliser leaves the text as it is,
but for the space put before it.

Defined cases: null counts as empty; the empty text has no token; repeated rows
keep their row, null ids stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk, and of the first overlap of two chunks.
CHUNK = 1 << 13
OVERLAP = 1 << 7
SPACES = " ▁"


class Counter:
    """Counts tokens as the library does for the whole text."""

    def __init__(self, path: str | None, chunk: int = CHUNK, overlap: int = OVERLAP, model=None) -> None:
        if model is None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.pieces = set(map(model.id_to_piece, range(model.get_piece_size())))
        self.longest = max(map(len, self.pieces))
        self.marked = not any(re.search("[^▁]▁", p) for p in self.pieces)
        self.chunk, self.overlap = chunk, overlap
        #: how often an overlap had to be widened, and a chunk to grow
        self.widened = self.grown = 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return self._spliced(text)
        return len(self.model.encode(text))

    def begins(self, text: str, start: int, stop: int) -> list[int]:
        """Where each token of a chunk begins in the text, in order."""
        return [start + b for b, _ in self.model.encode(text[start:stop], out_type="offset_mapping")["offsets"]]

    def stable(self, text: str, place: int) -> bool:
        """Whether no piece of the vocabulary lies across a place of the text."""
        if self.marked and text[place] in SPACES and text[place - 1] not in SPACES:
            return True
        first = max(0, place - self.longest + 1)
        around = text[first : place + self.longest - 1].replace(" ", "▁")
        at = place - first
        # the space before the text belongs to its first piece
        lead = "▁" if first == 0 else ""
        return not any(
            around[i:j] in self.pieces or (lead and i == 0 and lead + around[:j] in self.pieces)
            for i in range(at)
            for j in range(at + 1, min(len(around), i + self.longest) + 1)
        )

    def _spliced(self, text: str) -> int:
        # tokens before ``at`` are in the sum; the open chunk is start..stop, its tokens begin at ``held``
        total, at, start, stop = 0, 0, 0, min(len(text), self.chunk)
        held = self.begins(text, start, stop)
        while stop < len(text):
            overlap, found = self.overlap, None
            while found is None:
                begin = max(at, stop - overlap)
                to = min(len(text), begin + max(self.chunk, 2 * overlap))
                after = self.begins(text, begin, to)
                common = set(held).intersection(after)
                found = next((p for p in sorted(common, reverse=True) if max(at, begin) < p < stop and self.stable(text, p)), None)
                if found is None:
                    if begin == at:
                        break
                    overlap *= 2
                    self.widened += 1
            if found is None:
                self.grown += 1
                stop = min(len(text), 2 * stop - start)
                held = self.begins(text, start, stop)
                continue
            total += bisect_left(held, found) - bisect_left(held, at) if at else bisect_left(held, found)
            held, start, stop, at = after, begin, to, found
        return total + len(held) - (bisect_left(held, at) if at else 0)


@cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    model: str = MODEL,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path(model), chunk, overlap).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    counted = docs.select(F.col(doc_id).alias("id"), size.alias("n_bytes"), F.col(text).alias("t")).mapInArrow(
        tidy(run), f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return token_counts(table(spark, sf_dir, "documents"))
