"""How queries are declared: Spark SQL or a function, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


class Tables:
    """The tables of one folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **args) -> DataFrame:
        """Run Spark SQL with the tables that it names as views."""
        for name in set(re.findall(r"[a-z]+", text)) & set(TABLES):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = "") -> None:
        """oracle: other SQL than ``text``; None for none."""
        self.queries[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
        if oracle is not None:
            self.oracles[name] = oracle or text

    def frame(self, name: str, oracle: str | None = None) -> Callable:
        """Decorator of a function of ``Tables``."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
