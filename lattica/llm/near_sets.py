"""Near-duplicates by an exact share of word shingles, proposed by BK-trees over SimHash fingerprints.

A text's set holds the hashes of its five-word shingles, and its fingerprint is
their SimHash.  Sets with a share (Jaccard) of 0.8 or more have shingles in common
among their least: each of the ``LEADS`` least of both together is in both with a
chance of 0.8, so that a pair shares none of them with a chance under 0.2 to the
power of LEADS.  The texts that share one of these shingles form a shard; the
shard is a BK-tree (children keyed by their Hamming distance to the parent) whose
search follows only edges within ``radius`` bits, and what it finds is linked if
the whole sets have the share.  A share of 0.8 puts two fingerprints about ten
bits apart, so that a radius of 20 bits is over three deviations beyond.

Shingles that crowd a shard (more than ``cap`` texts) come last in the order of the
sets that have one of them among the least.  Such sets take the first fifth of
their shingles instead, which misses no pair.  Equal sets are united first.

Shards of at most ``cap`` texts are searched by all their members.  In a larger one
all are first compared with its least set; then those outside the component of the
least set search it (in trees of at most ``MAX_SHARD`` members, each visited by all
of them) for members of other components.  Links inside a component add nothing to
it, so that the components are those of all pairs.  There each set brings a mark, the
parities of how many of its shingles fall into each of ``MARK`` buckets: two marks
differ in no more places than the sets have shingles of their own, so that a pair
whose marks differ in too many is left out of the proposals, and none with the share
is.  (The fewer shingles, the sharper: beyond some 4,000 it leaves nothing out.)

Defined cases: words are those of ``simhash``; null texts count as empty; texts
without words are equal, texts under five words are one shingle; rows with a null
id are linked but never name a component; repeated rows keep their row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialize, scratch, tidy
from .components import connected_components
from .simhash import MAX_SHARD, SEED, BKForest, blocks_of_queries, majority, shingle_hashes, whole_shards

SHINGLE = 5
#: Sets of a shard that are compared pair by pair; least shingles that name a set's shards; bits.
CAP, LEADS, RADIUS = 32, 16, 20
#: Buckets of a mark, and pairs whose marks are compared at a time.
MARK, COMPARED = 2048, 1 << 14
#: Keys that may be broadcast to the sets, in bytes of their file.
BROADCAST_LIMIT = 16 << 20


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, sig, fp, tokens): each row's set, the hash that tells it from others, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps, sets = [], []
                for t in part.column(1):
                    hashes = shingle_hashes(t.as_py(), shingle)
                    fps.append(majority(hashes))
                    sets.append(np.unique(hashes.view(np.int64)))
                sigs = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sigs), pa.array(np.array(fps, np.uint64).view(np.int64)), tokens], ["id", "sig", "fp", "tokens"]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), f"id {kind}, sig long, fp long, tokens array<long>")


def _few(keys: DataFrame) -> DataFrame:
    """Broadcast a written table of keys if its files are small; else both sides are merged."""
    return F.broadcast(keys) if bytes_of(keys) <= BROADCAST_LIMIT else keys.hint("merge")


def _prefixes(sets: DataFrame, cap: int) -> DataFrame:
    """(tok, sig, fp, n, left): the first shingles of each set, and how many it has from there on."""
    n = F.size("tokens")
    upto = n - F.floor((4 * n + 4) / 5).cast("int") + 1
    least = sets.where(n > 0).select("sig", "fp", n.alias("n"), F.slice("tokens", 1, F.least(upto, F.lit(LEADS))).alias("first"))
    least = least.dropDuplicates(["sig"]).select("sig", "fp", "n", F.posexplode("first").alias("at", "tok"))
    least = materialize(least.select("tok", "sig", "fp", "n", (F.col("n") - F.col("at")).alias("left")))
    hot = materialize(least.groupBy("tok").agg(F.count("*").alias("of")).where(F.col("of") > cap).select("tok"))
    if hot.isEmpty():
        return least
    touched = materialize(least.join(_few(hot), "tok", "left_semi").select("sig").distinct())
    whole = materialize(sets.join(_few(touched), "sig", "left_semi").dropDuplicates(["sig"]))
    held = whole.select("sig", F.explode("tokens").alias("tok")).join(_few(hot), "tok", "left_semi")
    held = held.groupBy("sig").agg(F.sort_array(F.collect_set("tok")).alias("hot"))
    last = F.col("hot")
    moved = whole.join(held, "sig").select("sig", "fp", n.alias("n"), F.slice(F.concat(F.array_except("tokens", last), last), F.lit(1), upto).alias("first"))
    moved = moved.select("sig", "fp", "n", F.posexplode("first").alias("at", "tok"))
    moved = moved.select("tok", "sig", "fp", "n", (F.col("n") - F.col("at")).alias("left"))
    return materialize(least.join(_few(touched), "sig", "left_anti").select(*moved.columns).unionAll(moved))


def mark(tokens: np.ndarray) -> bytes:
    """The parity of each bucket's number of shingles."""
    counts = np.bincount((tokens.view(np.uint64) % np.uint64(MARK)).astype(np.int64), minlength=MARK)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def may_share(marks: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False for the pairs whose marks (rows of longs) rule out the share."""
    out = np.ones(len(x), bool)
    for at in range(0, len(x), COMPARED):
        i, j = x[at : at + COMPARED], y[at : at + COMPARED]
        out[at : at + COMPARED] = 9 * np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
    return out


def _marks(sets: DataFrame) -> DataFrame:
    """(sig, mark) of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [mark(t.values.to_numpy()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["sig", "mark"])

    return sets.select("sig", "tokens").mapInArrow(tidy(run), "sig long, mark binary")


def _proposed(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b): sets of a shard within the radius whose sizes and places leave room for the share.

    rows: keys, sig, fp, n, left, root, own (part of the tree), asks (searches it),
    and mark, where pairs are to be held against it.
    """
    marked = "mark" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in whole_shards(batches, keys):
            sig, fp, n, left, root = (table.column(c).to_numpy() for c in ("sig", "fp", "n", "left", "root"))
            fp = fp.view(np.uint64)
            own, asks = (table.column(c).to_numpy() for c in ("own", "asks"))
            inside = np.flatnonzero(own)
            if not len(inside):
                continue
            # one node for members of a shard with one fingerprint; they follow each other
            new = np.r_[True, (shard[inside][1:] != shard[inside][:-1]) | (fp[inside][1:] != fp[inside][:-1])]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(inside)])
            nodes = inside[begin]
            forest = BKForest(shard[nodes], fp[nodes])
            of_root = shard[nodes][forest.roots]
            who = np.flatnonzero(asks & np.isin(shard, of_root))
            if marked:
                marks = np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint64).reshape(-1, MARK // 64)
            rank = np.searchsorted(of_root, shard[who])
            members = np.bincount(np.searchsorted(of_root, shard[inside]), minlength=len(of_root))
            for block in blocks_of_queries(members[rank]):
                part = who[block]
                for q, node in forest.search(fp[part], forest.roots[rank[block]], radius):
                    many = size[node]
                    x = np.repeat(part[q], many)
                    y = inside[np.repeat(begin[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    ok = (root[x] != root[y]) & (9 * np.minimum(left[x], left[y]) >= 4 * (n[x] + n[y]))
                    # members that both search are met twice
                    ok &= ~(asks[y] & (sig[x] > sig[y]))
                    x, y = x[ok], y[ok]
                    if marked:
                        ok = may_share(marks, n, x, y)
                        x, y = x[ok], y[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[x], sig[y])), pa.array(np.maximum(sig[x], sig[y]))], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs with a share of 0.8 or more."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    met = materialize(pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).distinct())
    some = materialize(sets.join(_few(met), "sig", "left_semi").dropDuplicates(["sig"]).select("sig", "tokens"))
    x, y = (some.select(F.col("sig").alias(k), F.col("tokens").alias(f"of_{k}")) for k in "ab")
    both = 9 * F.size(F.array_intersect("of_a", "of_b")) >= 4 * (F.size("of_a") + F.size("of_b"))
    return materialize(pairs.join(x, "a").join(y, "b").where(both).select("a", "b"))


def links(sets: DataFrame, cap: int = CAP, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) of sets (sig, fp, tokens; equal ones may be repeated) that span all components."""
    each = _prefixes(sets, cap)
    yes, no = F.lit(True), F.lit(False)
    sizes = materialize(each.groupBy("tok").agg(F.count("*").alias("of"), F.min("sig").alias("least")).where(F.col("of") > 1))
    big = materialize(sizes.where(F.col("of") > cap))
    # shingles of one set propose nothing
    small = each.join(sizes.where(F.col("of") <= cap).select("tok"), "tok", "left_semi")
    small = _proposed(small.select("tok", "sig", "fp", "n", "left", F.col("sig").alias("root"), yes.alias("own"), yes.alias("asks")), ["tok"], radius)
    if big.isEmpty():
        return _verified(small, sets)
    crowd = materialize(each.join(_few(big), "tok"))
    stars = crowd.where("sig <> least").select(F.col("sig").alias("a"), F.col("least").alias("b"))
    found = _verified(small.unionAll(stars), sets)
    root = connected_components(found)
    of = lambda k: root.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    crowd = crowd.join(of("sig"), "sig", "left").join(of("least"), "least", "left")
    trees = F.ceil(F.col("of") / max_shard).cast("int")
    crowd = crowd.select("tok", "sig", "fp", "n", "left", F.coalesce("sig_root", "sig").alias("root"), F.coalesce("least_root", "least").alias("to"), trees.alias("trees"))
    crowd = materialize(crowd)
    own = crowd.select("tok", F.pmod(F.xxhash64("sig"), F.col("trees")).cast("int").alias("tree"), "sig", "fp", "n", "left", "root", yes.alias("own"), no.alias("asks"))
    visits = crowd.where("root <> to").select("tok", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "sig", "fp", "n", "left", "root", no.alias("own"), yes.alias("asks"))
    met = materialize(crowd.select("sig").distinct())
    marks = materialize(_marks(sets.join(_few(met), "sig", "left_semi").dropDuplicates(["sig"])))
    return found.unionAll(_verified(_proposed(own.unionAll(visits).join(marks, "sig"), ["tok", "tree"], radius), sets))


def verified_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """One row for each document: doc_id, fp, sig (of its set), component_id."""
    with scratch() as own:
        named, least = map(own.keep, _named(docs, doc_id, text, shingle, radius, cap))
    return named.join(least, "root").select(F.col("id").alias(doc_id), "fp", "sig", "component_id")


def _named(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, sig, root) of each row, and (root, component_id)."""
    each = materialize(shingle_sets(docs, doc_id, text, shingle))
    joined = connected_components(links(each.select("sig", "fp", "tokens"), cap, radius))
    named = each.select("id", "fp", "sig").join(joined, F.col("sig") == F.col("node"), "left").select("id", "fp", "sig", F.coalesce("root", "sig").alias("root"))
    named = materialize(named)
    return named, materialize(named.groupBy("root").agg(F.min("id").alias("component_id")))
