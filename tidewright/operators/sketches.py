"""Profiles from stored sketches: a sketch for each part of a table (say a day), merged over any parts without reading their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles
from .writes import ParquetTable

#: Distinct values: the logarithm of the registers. The relative error is about 1.04 / 2 ** (LG / 2); few values are counted exactly.
LG = 18
#: Percentiles: the rank error is about 2.3 / K. Up to about K values are kept exactly.
K = 32_768


def sketched(df: DataFrame, by: list[str], distinct: list[str] = (), numbers: list[str] = (), lg: int = LG, k: int = K) -> DataFrame:
    """One row for each group: rows, for each column of either list <c>_nulls, for `distinct` <c>_hll, for `numbers` <c>_low, <c>_high and <c>_kll.

    Aggregation is partial: each task sends one sketch a group, whatever its rows.
    """
    made: list[Column] = [F.count("*").alias("rows")]
    for c in dict.fromkeys([*distinct, *numbers]):
        made.append(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))
    for c in distinct:
        made.append(F.hll_sketch_agg(c, lg).alias(f"{c}_hll"))
    for c in numbers:
        value = F.col(c).cast("double")
        made += [F.min(value).alias(f"{c}_low"), F.max(value).alias(f"{c}_high"), F.kll_sketch_agg_double(value, k).alias(f"{c}_kll")]
    return df.groupBy(*by).agg(*made)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups. Merging again, or in another order, stays within the bounds of one sketch over all rows."""
    how = {"rows": F.sum, "nulls": F.sum, "low": F.min, "high": F.max, "hll": F.hll_union_agg, "kll": F.kll_merge_agg_double}
    columns = [c for c in sketches.columns if c == "rows" or c.rsplit("_", 1)[-1] in how and c not in by]
    return sketches.groupBy(*by).agg(*(how[c.rsplit("_", 1)[-1]](c).alias(c) for c in columns if c not in by))


def estimated(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """Sketches read: <c>_distinct for <c>_hll, and <c>_<name> for each percentile of `at` for <c>_kll; null where a group has no value."""
    out: list[Column] = []
    for c in sketches.columns:
        if c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct"))
        elif c.endswith("_kll"):
            some = F.col(f"{c[:-4]}_low").isNotNull()
            out += [F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))).alias(f"{c[:-4]}_{n}") for n, q in at.items()]
        else:
            out.append(F.col(c))
    return sketches.select(*out)


def refresh(table: ParquetTable, df: DataFrame, part: str, by: list[str] = (), **options) -> None:
    """Stores the sketches of the parts that `df` has, in place of those that were there; other parts aren't read.

    A part must come whole: its rows in `df` are all it has.
    """
    new = sketched(df, [part, *by], **options)
    table.write(new, "delete_insert", [part])


def counted(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """How often each value of a column stands in each group: exact where sketches estimate, and merged by adding."""
    return df.groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def refresh_counts(table: ParquetTable, df: DataFrame, part: str, by: list[str], column: str) -> None:
    """`refresh` for value counts."""
    table.write(counted(df, [part, *by], column), "delete_insert", [part])


def exact(counts: DataFrame, by: str, column: str, at: dict[str, float] | None = None) -> DataFrame:
    """A profile of a column from its value counts: rows, <c>_nulls and <c>_distinct, or with percentiles `at` <c>_low, <c>_high and <c>_<name> in place of <c>_distinct."""
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias(f"{column}_nulls")
    if at is None:
        once = counts.groupBy(by, "value").agg(F.sum("n").alias("n"))
        return once.groupBy(by).agg(F.sum("n").alias("rows"), nulls, F.count("value").alias(f"{column}_distinct"))
    out = counts.groupBy(by).agg(F.sum("n").alias("rows"), nulls, F.min("value").alias(f"{column}_low"), F.max("value").alias(f"{column}_high"))
    places = percentiles(counts, by, "value", {}, {f"{column}_{n}": q for n, q in at.items()}, "n").withColumnRenamed(by, "by_")
    return out.join(places, F.col(by).eqNullSafe(F.col("by_")), "left").drop("by_")
