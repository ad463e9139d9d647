"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints are taken once for each text and reduced to the distinct ones, so
that exact copies cost nothing further.  64 bits are cut into ``radius + 2``
blocks: two fingerprints at most ``radius`` bits apart agree on at least two
blocks, so for each pair of blocks all fingerprints with the same bits there
form a shard, and every link lies inside one.  Each shard is a BK-tree (children
keyed by their Hamming distance to the parent); a search follows only edges
within the radius.  A task grows and searches the trees of all its shards level
by level, and gives a spanning set of links, never all pairs.

Shards over ``max_shard`` fingerprints are split: members within the radius of
the shard's pivot are linked to it at once; the shard is cut by hash into trees
of bounded size, and only members not linked to the pivot are sent to every
tree.  (Links between two members of the pivot's star add nothing to a
component.)

Defined cases: null texts count as empty; texts without words have fingerprint
zero and are linked like any other; repeated rows each keep their row; rows with
a null id are linked but never name a component (one of only null ids has a null
component); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, tidy
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
MAX_SHARD = 4096
#: Hashes counted, and pairs of a query and a tree's member that may meet, at a time.
BLOCK = 1 << 16
PAIRS = 1 << 18
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included (fewer words: of all of them; none: empty)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(first, last)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), f"id {kind}, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of ``radius + 2`` blocks, as signed longs."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << (j - i)) - 1) << i for i, j in zip(cuts, cuts[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKForest:
    """BK-trees of many shards, grown and searched level by level."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        """shard: numbers in ascending order; fp: distinct inside a shard."""
        self.fp = fp
        new = np.r_[True, shard[1:] != shard[:-1]] if len(fp) else np.zeros(0, bool)
        #: the root of each shard by its rank, and of each node
        self.roots = np.flatnonzero(new)
        self.root_of = self.roots[np.cumsum(new) - 1] if len(fp) else self.roots
        keys, nodes = [], []
        active = np.flatnonzero(~new)
        at = self.root_of[active]
        while len(active):
            key = at * 65 + np.bitwise_count(fp[active] ^ fp[at])
            own, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = active[first]
            keys.append(own)
            nodes.append(child)
            rest = np.ones(len(active), bool)
            rest[first] = False
            active, at = active[rest], child[back[rest]]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.nodes = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in query, nodes) at most ``radius`` bits apart, level by level."""
        q, at = np.arange(len(query)), root
        while len(q):
            d = np.bitwise_count(query[q] ^ self.fp[at]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], at[near]
            lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 1))
            hi = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right")
            n = np.maximum(hi - lo, 0)
            q = np.repeat(q, n)
            at = self.nodes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x and y; label: each node's smallest known mate."""
    while True:
        lx, ly = label[x], label[y]
        odd = lx != ly
        if not odd.any():
            return
        x, y = x[odd], y[odd]
        low, high = np.minimum(lx[odd], ly[odd]), np.maximum(lx[odd], ly[odd])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def blocks_of_queries(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of queries whose trees have at most PAIRS members together (or one query)."""
    work = np.cumsum(sizes)
    at = 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, to)
        at = to


def shard_links(shard: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links inside each shard, as positions.

    own: False for visitors, that search the shard's tree but are not part of it.
    """
    inside = np.flatnonzero(own)
    forest = BKForest(shard[inside], fp[inside])
    if not len(inside):
        return inside, inside
    rank = np.searchsorted(shard[inside][forest.roots], shard)
    root = forest.roots[rank]
    size = np.bincount(forest.root_of, minlength=len(inside))[root]
    label = np.arange(len(fp))
    some = np.flatnonzero((size > 1) | ~own)
    for part in blocks_of_queries(size[some]):
        who = some[part]
        for q, node in forest.search(fp[who], root[who], radius):
            _merge(label, who[q], inside[node])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def whole_shards(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole shards, about BLOCK rows each, with the shard's number of each row; rows come sorted by ``keys``."""

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        # more than one shard is held
        if n >= BLOCK and any(held[0].column(k)[0] != held[-1].column(k)[-1] for k in keys):
            table = pa.Table.from_batches(held)
            shard = numbers(table)
            upto = int(np.searchsorted(shard, shard[-1]))
            yield table.slice(0, upto), shard[:upto]
            held = table.slice(upto).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
    if n:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b) from rows (keys, fp, own); shards are the rows with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in whole_shards(batches, keys):
            fp = table.column("fp").to_numpy()
            x, y = shard_links(shard, fp.view(np.uint64), table.column("own").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(tidy(run), "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that span all components at ``radius``."""
    table = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(block_masks(radius))))
    each = distinct.select("fp", F.explode(table).alias("x")).select(
        F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp"
    )
    big = materialize(each.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where(F.col("n") > max_shard))
    if big.isEmpty():
        return _links(each.select("t", "key", "fp", F.lit(True).alias("own")), ["t", "key"], radius)
    small = _links(each.join(big, ["t", "key"], "left_anti").select("t", "key", "fp", F.lit(True).alias("own")), ["t", "key"], radius)
    trees = F.ceil(F.col("n") / (max_shard / 2)).cast("int")
    star = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius
    each = each.join(big, ["t", "key"]).withColumn("star", star)
    visitors = each.groupBy("t", "key").agg(F.ceil(F.count_if(~F.col("star")) / max_shard).cast("int").alias("parts"))
    held = materialize(
        each.join(materialize(visitors), ["t", "key"]).select(
            "t", "key", "fp", "pivot", "star", "parts", trees.alias("trees"),
            F.pmod(F.xxhash64("fp"), trees).cast("int").alias("tree"),
            F.when(F.col("parts") > 0, F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))).cast("int").alias("part"),
        )
    )
    stars = held.where("star and fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # each tree once for each part of the visitors; part -1 links the tree's own members
    own = held.select("t", "key", "tree", F.explode(F.sequence(F.lit(-1), F.col("parts") - 1)).alias("part"), "fp", F.lit(True).alias("own"))
    visits = held.where("not star").select("t", "key", upto(F.col("trees")).alias("to"), "part", "fp", "tree")
    visits = visits.where("to <> tree").select("t", "key", F.col("to").alias("tree"), "part", "fp", F.lit(False).alias("own"))
    return small.unionAll(stars).unionAll(_links(own.unionAll(visits), ["t", "key", "tree", "part"], radius))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    max_shard: int = MAX_SHARD,
    verify: bool = False,
) -> DataFrame:
    """One row for each document: doc_id, fp (signed long), component_id.

    With ``verify`` the trees only propose pairs: shards are the texts that share
    one of their first shingles, and those found within the radius are linked if
    their sets of shingles share 0.8 or more (``near_sets``).
    """
    if verify:
        from .near_sets import verified_duplicates

        return verified_duplicates(docs, doc_id, text, shingle, radius)
    fps = materialize(fingerprints(docs, doc_id, text, shingle))
    with scratch() as own:
        distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")))
        joined = connected_components(links(distinct, radius, max_shard))
        named = distinct.join(joined, distinct.fp == joined.node, "left").select(
            "fp", "rep", F.coalesce("root", "fp").alias("root")
        )
        named = own.keep(materialize(named))
        least = own.keep(materialize(named.groupBy("root").agg(F.min("rep").alias("component_id"))))
    named = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return fps.join(named, fps.fp == named.of).select(F.col("id").alias(doc_id), "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
