"""Helpers shared by the operators: shared storage, ASCII folding, columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of an Arrow batch that is sent to a Python worker.
BATCH_ROWS = 2000
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is missing on one machine (tests) a temporary folder
    is taken, once a session; on a cluster its absence is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lattica.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("lattica.shared.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage and computes ``df`` once, and the copy outlives any
    executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._copy = path
    if _open:
        _open[-1].made.append((spark, path))
    return copy


class Scratch:
    """What ``scratch`` gives: copies that outlive it are named with ``keep``."""

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [x for x in self.made if x[1] != df._copy]
        if _open and _open[-1] is not self:
            _open[-1].made.append((df.sparkSession, df._copy))
        elif len(_open) > 1:
            _open[-2].made.append((df.sparkSession, df._copy))
        return df


_open: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Copies that ``materialize`` makes inside are deleted at the end, but for those kept.

    What is kept has been written, so that no lineage goes back to a deleted copy.
    """
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for spark, path in own.made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(df: DataFrame) -> int:
    """What the optimizer proves of ``df``'s size in bytes (a scan's file sizes)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    # batches of texts are held in the executor and in the worker at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; workers live on for other tasks, so each task frees what it held."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
