"""Global shuffle into shards: two passes over memory-sized buckets.

First pass: every record is scattered to a bucket by a seeded hash of its id, so
that buckets are uniform and each fits a task's memory.  Second pass: each
bucket is put into a fixed order and Fisher-Yates shuffled with a generator
seeded by the bucket.  The buckets one after another are a random order of all
records; the record at place p goes to shard ``p mod n`` as its
``p div n``-th.  So shard counts are at most one apart (law ``rows``) and the
slots have no gaps.  Only the counts of buckets cross the whole data, as a small
table; a lost task repeats one bucket with the same result.

If ids repeat so often that a bucket outgrows ``bucket_bytes`` four times, the
records are scattered anew by id and place of reading.

Defined cases: null texts have no bytes (size 8, CRC 0); null and repeated ids
are placed like any other record; an empty table gives no rows; other columns
travel along, but for such as are named like the operator's own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 24
SEED = 42
BUCKET_BYTES = 4 << 20
OVERHEAD = 8


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of n places."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n_shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs``, with shard (0 to n_shards - 1) and slot."""
    docs = docs.drop("shard", "slot", "_bucket")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    key = [F.lit(seed), F.col(doc_id)]
    scatter = lambda key: F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    counts = lambda key: docs.groupBy(scatter(key).alias("_bucket")).agg(F.count("*").alias("_n"), F.sum(size).alias("_bytes"))
    sizes = counts(key)
    if (sizes.agg(F.max("_bytes")).first()[0] or 0) > 4 * bucket_bytes:
        key = [*key, F.monotonically_increasing_id()]
        sizes = counts(key)
    # one row a bucket: summed by blocks of 4096 buckets, so that no window sees them all
    block = F.floor(F.col("_bucket") / 4096)
    sums = sizes.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_m"))
    before = sums.withColumn("_start", F.coalesce(F.sum("_m").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_block", block).join(before, "_block").select(
        "_bucket", (F.col("_start") + F.coalesce(inside, F.lit(0))).alias("_first")
    )
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)

    def second(table: pa.Table, start: pa.Table) -> pa.Table:
        bucket, first = (start.column(c)[0].as_py() for c in ("_bucket", "_first"))
        texts = table.column(at_text)
        crc = pa.array([zlib.crc32((t.as_py() or "").encode()) for t in texts], pa.int64())
        keys = pa.table({"id": table.column(at_id), "crc": crc, "null": texts.is_null(), "at": pa.array(range(table.num_rows))})
        fixed = keys.sort_by([("id", "ascending"), ("crc", "ascending"), ("null", "ascending")]).column("at").to_numpy()
        order = fixed[fisher_yates(table.num_rows, [seed, bucket])]
        place = first + np.arange(table.num_rows)
        out = table.take(pa.array(order)).drop_columns(["_bucket"])
        return out.append_column("shard", pa.array(place % n_shards, pa.int32())).append_column("slot", pa.array(place // n_shards))

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    met = docs.withColumn("_bucket", scatter(key)).groupBy("_bucket").cogroup(starts.groupBy("_bucket"))
    return met.applyInArrow(second, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard; the files hold the rows in the order of their slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
