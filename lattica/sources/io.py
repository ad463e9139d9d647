"""Readers and writers: delimited text, tables from queries, functional row changes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lattica.shared.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("lattica.shared.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def copy_from(
    spark: SparkSession, path: str, schema: str, form: str = "text", delimiter: str | None = None, null: str | None = None,
    header: bool = False, quote: str = '"', where: str | None = None, force_null: tuple[str, ...] = (),
) -> DataFrame:
    r"""Load delimited text.  form ``text``: tabs, ``\N`` for null, no quotes; ``csv``: commas, empty for null.

    force_null: columns where a quoted null string counts as null too.
    """
    csv = form == "csv"
    null = null if null is not None else "" if csv else "\\N"
    reader = spark.read.schema(schema).option("sep", delimiter or ("," if csv else "\t")).option("header", header)
    reader = reader.option("mode", "FAILFAST").option("nullValue", null).option("quote", quote if csv else "\0").option("escape", quote if csv else "\\")
    df = reader.option("emptyValue", "").csv(path)
    for c in force_null:
        df = df.withColumn(c, F.when(F.col(c) != null, F.col(c)))
    return df if where is None else df.where(where)


def copy_to(df: DataFrame, path: str, form: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False) -> None:
    csv = form == "csv"
    writer = df.write.option("sep", delimiter or ("," if csv else "\t")).option("header", header)
    writer.option("nullValue", null if null is not None else "" if csv else "\\N").option("emptyValue", '""' if csv else "").csv(path)


def create_table_as(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a query's rows as Parquet, sorted inside files where asked for, and read them."""
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


class MaterializedView:
    """A query's rows on disk; refresh writes a new version beside the old and then switches."""

    def __init__(self, spark: SparkSession, name: str, query) -> None:
        self.spark, self.base, self.query, self.version = spark, fresh_path(spark, name), query, 0
        self.refresh()

    def refresh(self) -> None:
        self.query().write.parquet(f"{self.base}/v{self.version + 1}")
        self.version += 1

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/v{self.version}")


def delete_rows(target: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition isn't true stay, those for which it is null as well."""
    return target.where(~F.coalesce(where, F.lit(False)))


def update_rows(target: DataFrame, where: Column, **changes: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns))


def upsert(target: DataFrame, source: DataFrame, key: list[str], on_conflict: str = "update") -> DataFrame:
    """Insert source rows; where the key exists, ``update`` takes the source's row and ``nothing`` the target's."""
    source = source.select(*target.columns)
    if on_conflict == "update":
        return target.join(source, key, "left_anti").select(*target.columns).unionAll(source)
    return target.unionAll(source.join(target, key, "left_anti").select(*target.columns))


