"""Connected groups of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that one task takes. A small graph on a large cluster is not dealt over all its partitions in every round.
TASK_LINKS = 100_000


def _large(e: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)


def _small(e: DataFrame, tasks: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least one."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """For each node of `links`: node, root (the least node that it reaches). Nodes need an order; null ends are ignored.

    Links stay distributed. A node with very many links costs a partial minimum and a join that Spark can split. The
    number of rounds grows with the logarithm of the longest path; each round is cut at the shared checkpoint folder.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(e)
    while before[0]:
        tasks = 1 + before[0] // TASK_LINKS
        e = cut(_small(_large(e.coalesce(tasks), tasks), tasks))
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
