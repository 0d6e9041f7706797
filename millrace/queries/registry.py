"""Registry of named queries: a Spark form and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet readers of one test-data folder: ``t.orders`` and so on."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df

    def some(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}

    @cached_property
    def every(self) -> dict[str, DataFrame]:
        return self.some(*TABLE_NAMES)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its DuckDB twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
