"""Collects queries with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


class Tables:
    """The tables of one scale-factor folder, read as they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **args) -> DataFrame:
        """Runs SQL over the tables, given as {name} in the text."""
        names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")
        return self.spark.sql(text, args=args or None, **{n: getattr(self, n) for n in names if "{" + n + "}" in text})


def money(c: str | Column) -> Column:
    """A sum of cents, exact and then a double, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double")
