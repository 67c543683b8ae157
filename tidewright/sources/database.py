"""Database tables over JDBC. Spark pushes filters and projections down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REFUSED = (T.ArrayType, T.StructType, T.MapType)


def read_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None, schema: str | None = None, doubles: bool = False, **options) -> DataFrame:
    """A table or a query (just one of them). split: (column, least, most, partitions) reads in parallel.

    Filters and the choice of columns reach the database as Catalyst plans them. `schema` gives columns types of their own
    ("a DOUBLE, b STRING"); `doubles` reads all other numbers of fixed precision as doubles. Types that Spark doesn't know
    are read as text where the dialect has them so.
    """
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("dbtable", table) if table else reader.option("query", query)
    if schema:
        reader = reader.option("customSchema", schema)
    if split and table:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), split):
            reader = reader.option(k, v)
    df = reader.load()
    if doubles and (exact := [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]):
        df = reader.option("customSchema", ", ".join([schema] * bool(schema) + [f"`{c}` DOUBLE" for c in exact])).load()
    return df


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options) -> None:
    """Writes in batches; nested columns are refused."""
    if nested := [f.name for f in df.schema if isinstance(f.dataType, REFUSED)]:
        raise ValueError(f"a database table can't hold {nested}")
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()
