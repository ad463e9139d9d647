"""Surfaces for own functions: SQL functions, Arrow functions, table functions, window functions, domains, sources."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import Registry

R = Registry()


def domain(value: Column, check: Column, name: str) -> Column:
    """The value, or an error where the check is false (null passes)."""
    kind = F.raise_error(F.lit(f"value for domain {name} violates check constraint"))
    return F.when(F.coalesce(check, F.lit(True)), value).otherwise(kind)


def not_null(value: Column, name: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"domain {name} does not allow null values")))


@F.pandas_udf(T.LongType())
def greatest_divisor(a: pd.Series, b: pd.Series) -> pd.Series:
    """A procedural function: a loop for each row, batches by Arrow."""
    return pd.Series([math.gcd(int(x), int(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def middle(v: pd.Series) -> float:
    """A user-defined aggregate that also serves as a window function."""
    return float(v.median())


def words_function():
    """A table function: one row for each word."""

    @F.udtf(returnType="position int, word string")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split(" "), 1):
                yield i, w

    return Words


def register_series_source(spark) -> None:
    """A data source of our own: numbers from ``start`` to ``stop``, read in ``parts`` partitions."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, low: int, high: int) -> None:
            super().__init__((low, high))
            self.low, self.high = low, high

    class Reader(DataSourceReader):
        def __init__(self, options) -> None:
            self.start, self.stop, self.parts = (int(options.get(k, d)) for k, d in (("start", 0), ("stop", 10), ("parts", 2)))

        def partitions(self):
            cut = [self.start + (self.stop - self.start) * i // self.parts for i in range(self.parts + 1)]
            return [Part(a, b) for a, b in zip(cut, cut[1:])]

        def read(self, partition):
            for i in range(partition.low, partition.high):
                yield (i,)

    class Series(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lattica_series"

        def schema(self) -> str:
            return "i long"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Series)


@R.frame("SC17_custom_source", "SELECT CAST(unnest(range(5, 40)) AS BIGINT) AS i")
def _source(t) -> DataFrame:
    register_series_source(t.spark)
    return t.spark.read.format("lattica_series").option("start", 5).option("stop", 40).option("parts", 3).load()


@R.frame("U1_sql_function", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _sql_function(t) -> DataFrame:
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return t.sql("SELECT l_orderkey, l_linenumber, round(net_price(l_extendedprice, l_discount), 4) AS net FROM lineitem")


@R.frame("U2_procedural", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g FROM part")
def _procedural(t) -> DataFrame:
    return t.part.select("p_partkey", greatest_divisor("p_partkey", "p_size").alias("g"))


@R.frame("U6_table_function", "SELECT p_partkey, CAST(generate_subscripts(w, 1) AS INT) AS position, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def _table_function(t) -> DataFrame:
    t.spark.udtf.register("lattica_words", words_function())
    return t.sql("SELECT p_partkey, position, word FROM part, LATERAL lattica_words(p_name)")


@R.frame("U7_user_aggregate", "SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY c_nationkey")
def _aggregate(t) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(middle("c_acctbal").alias("m"))


@R.frame("U8_user_window", "SELECT c_custkey, median(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer")
def _window(t) -> DataFrame:
    return t.customer.select("c_custkey", middle("c_acctbal").over(Window.partitionBy("c_nationkey")).alias("m"))


@R.frame("U9_domain", "SELECT p_partkey, p_size FROM part")
def _domain(t) -> DataFrame:
    size = not_null(domain(F.col("p_size"), F.col("p_size") > 0, "positive"), "positive")
    return t.part.select("p_partkey", size.cast("int").alias("p_size"))
