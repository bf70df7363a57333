"""Queries over the given tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenemark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the independent oracle."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def heavy(self, name: str) -> DataFrame:
        """The table for CPU-heavy expressions: a scan with fewer splits than cores is
        spread first."""
        return spread(getattr(self, name))

    def sql(self, text: str, *names: str, heavy: bool = False) -> DataFrame:
        """Run a SELECT over the named tables (``{name}`` in the text)."""
        get = self.heavy if heavy else self.__getattr__
        return self.spark.sql(text, **{n: get(n) for n in names})
