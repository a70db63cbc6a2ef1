"""Registry of the queries over the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Base tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        schema = self.read(name).schema
        # a table is a file or a folder of files: as a pattern the path takes both
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and other numbers as double, for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of :class:`Tables`; ``sql`` is its oracle."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
