"""Column profiles in one pass, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = "column string, kind string, nulls long, least double, most double, mean double, least_bytes long, most_bytes long, distinct long, true_count long, false_count long"


def _of(field: T.StructField) -> Column:
    """The aggregates of one column as a struct of FIELDS."""
    c = F.col(f"`{field.name}`")
    none = F.lit(None)
    kind, values = "other", {}
    if isinstance(field.dataType, T.BooleanType):
        kind, values = "boolean", {"true_count": F.count_if(c), "false_count": F.count_if(~c)}
    elif isinstance(field.dataType, T.NumericType):
        d = c.cast("double")
        kind, values = "numeric", {"least": F.min(d), "most": F.max(d), "mean": F.avg(d)}
    elif isinstance(field.dataType, T.StringType):
        n = F.octet_length(c).cast("long")
        kind, values = "string", {"least_bytes": F.min(n), "most_bytes": F.max(n), "distinct": F.count_distinct(c)}
    values |= {"column": F.lit(field.name), "kind": F.lit(kind), "nulls": F.count_if(c.isNull())}
    return F.struct(*(values.get(f.name, none).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(FIELDS)))


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: nulls; least, most and mean of numbers as doubles; byte lengths and distinct values of strings; counts of booleans."""
    return df.agg(F.array(*map(_of, df.schema)).alias("all_")).select(F.explode("all_").alias("p")).select("p.*")


def sample_first(df: DataFrame, n: int = 100, key: str | None = None) -> DataFrame:
    return (df.orderBy(key) if key else df).limit(n)


def sample_random(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed and keys, in the order of the key."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(mark, key).limit(n).orderBy(key)


def sampled(df: DataFrame, mode: str, n: int = 100, key: str | None = None, seed: int = 0) -> DataFrame:
    """The rows that a profile looks at: the first n by key, n at random (the same for the same seed and keys), or all (full)."""
    if mode == "full":
        return df
    if mode == "first":
        return sample_first(df, n, key)
    if mode != "random" or key is None:
        raise ValueError(f"no such sample: {mode}" if mode != "random" else "a random sample needs a key")
    return sample_random(df, n, seed, key)
