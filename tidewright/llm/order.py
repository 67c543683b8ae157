"""Places of rows in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

_ROW_BITS = 33  # monotonically_increasing_id has the partition above these bits, the row's place in it below


def placed(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds place_ (from 0) of each row within its group (a column without nulls) and count_, the rows of the group.

    Rows are range-partitioned by group and order and sorted; a row's place is its place in the partition plus the rows of
    its group in the partitions before. The only windows have a row for each partition of a group. The order must leave
    no ties but between equal rows.
    """
    keys = [F.col(group).asc(), *order]
    row = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_", row)
    rows = cut(rows.withColumn("part_", F.shiftright("row_", _ROW_BITS)).withColumn("row_", F.col("row_").bitwiseAND((1 << _ROW_BITS) - 1)))
    sizes = rows.groupBy(group, "part_").agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("n_").over(whole.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(whole).alias("count_"))
    return rows.join(sizes, [group, "part_"]).withColumn("place_", F.col("row_") + F.col("shift_")).drop("row_", "part_", "shift_")
