"""Ranks over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut


def with_rank(df: DataFrame, col: str, key: str) -> DataFrame:
    """Adds rank_ (from 1, nulls last, ties by key) and count_.

    Rows are range-partitioned; each partition counts its own, and the counts of those before are added.
    """
    parts = cut(df.repartitionByRange(F.col(col).asc_nulls_last(), F.col(key)).withColumn("part_", F.spark_partition_id()))
    sizes = parts.groupBy("part_").agg(F.count("*").alias("size_"))  # a row for each partition
    every = W.orderBy("part_")
    before = sizes.select("part_", F.coalesce(F.sum("size_").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("size_").over(W.partitionBy()).alias("count_"))
    local = F.row_number().over(W.partitionBy("part_").orderBy(F.col(col).asc_nulls_last(), key))
    return parts.withColumn("local_", local).join(before, "part_").withColumn("rank_", F.col("local_") + F.col("before_")).drop("part_", "local_", "before_")


def rank_quintile(df: DataFrame, col: str, key: str) -> DataFrame:
    """Adds quintile: rank / count * 5, truncated, between 1 and 5."""
    ranked = with_rank(df, col, key)
    five = F.floor(F.col("rank_") / F.col("count_") * 5)
    return ranked.withColumn("quintile", F.least(F.lit(5), F.greatest(F.lit(1), five)).cast("int")).drop("rank_", "count_")


def percentiles(df: DataFrame, by: str, col: str, between: dict[str, float], at: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact percentiles of a column for each group: `between` interpolates, `at` takes a value that stands there. Nulls don't count. A row stands for `weight` rows.

    Equal values are counted first. Then values are range-partitioned; each partition counts its own rows of a group, the
    counts of those before are added, and only the values around the wanted places are kept.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(by, col).agg((F.sum(weight) if weight else F.count("*")).alias("n_"))
    parts = cut(counts.repartitionByRange(F.col(col)).withColumn("part_", F.spark_partition_id()))
    sizes = parts.groupBy(by, "part_").agg(F.sum("n_").alias("size_"))  # a row for each partition of a group
    group = W.partitionBy(by)
    before = sizes.select(F.col(by).alias("by_"), F.col("part_").alias("at_"), F.coalesce(F.sum("size_").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("size_").over(group).alias("count_"))
    upto = F.sum("n_").over(W.partitionBy(by, "part_").orderBy(col).rowsBetween(W.unboundedPreceding, 0))
    ranked = parts.withColumn("upto_", upto).join(before, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("at_"))).withColumn("upto_", F.col("upto_") + F.col("before_"))
    low = {n: F.floor((F.col("count_") - 1) * q) for n, q in between.items()}
    place = {**{f"{n}_lo_": low[n] for n in between}, **{f"{n}_hi_": F.ceil((F.col("count_") - 1) * q) for n, q in between.items()}, **{f"{n}_at_": F.greatest(F.lit(0), F.ceil(F.col("count_") * q) - 1) for n, q in at.items()}}
    stands = lambda k: (F.col("upto_") > k) & (F.col("upto_") - F.col("n_") <= k)
    found = ranked.groupBy(by).agg(*(F.max(F.when(stands(k), F.col(col))).alias(n) for n, k in place.items()), F.max("count_").alias("count_"))
    part = lambda n, q: (F.col("count_") - 1) * q - F.floor((F.col("count_") - 1) * q)
    return found.select(by, *((F.col(f"{n}_lo_") + (F.col(f"{n}_hi_") - F.col(f"{n}_lo_")) * part(n, q)).alias(n) for n, q in between.items()), *(F.col(f"{n}_at_").alias(n) for n in at))
