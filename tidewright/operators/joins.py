"""Joins beyond plain keys."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

Pairs = list[tuple[str, str]]


def collision_safe_join(left: DataFrame, right: DataFrame, how: str, on: Pairs) -> DataFrame:
    """Joins on pairs of columns; a name that both sides have becomes left_<name> and right_<name>."""
    both = set(left.columns) & set(right.columns)
    a = left.select(*(F.col(c).alias(f"left_{c}" if c in both else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(f"right_{c}" if c in both else c) for c in right.columns))
    if how == "cross":
        return a.crossJoin(b)
    name = lambda side, c: f"{side}_{c}" if c in both else c
    return a.join(b, reduce(and_, (a[name("left", x)] == b[name("right", y)] for x, y in on)), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Pairs, how: str = "inner") -> DataFrame:
    """Joins on pairs of columns where null equals null. The sides share no column name."""
    return left.join(right, reduce(and_, (left[x].eqNullSafe(right[y]) for x, y in on)), how)


#: Pairs of rows of like cells that one task of a band join compares.
PAIRS = 20_000_000


def band_join(left: DataFrame, right: DataFrame, bands: list[tuple[str, str, float]]) -> DataFrame:
    """Pairs of rows that differ by less than a width in each of some dimensions: (left column, right column, width).

    Both sides get the grid cell of their values. The right side stands in its own cell and all around it, so an equi join
    on the cell finds every pair; a final filter is exact. No cross product. The left rows of a crowded cell are dealt into
    chunks that each meet all its right rows, and partitions are as many as the pairs need, as a few megabytes of rows can
    make more pairs than adaptive execution, which goes by bytes, would give a task.
    """
    cell = lambda c, w: F.floor(F.col(c) / w)
    real = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  # nothing is near any other
    left, right = left.filter(reduce(and_, (real(x) for x, _, _ in bands))), right.filter(reduce(and_, (real(y) for _, y, _ in bands)))
    a = left.withColumns({f"cell_{k}_": cell(x, w) for k, (x, _, w) in enumerate(bands)})
    around = [F.struct(*((cell(y, w) + d).alias(f"near_{k}_") for k, ((_, y, w), d) in enumerate(zip(bands, step)))) for step in product((-1, 0, 1), repeat=len(bands))]
    b = right.withColumn("near_", F.explode(F.array(*around))).select(*right.columns, "near_.*")
    cells, nears = [f"cell_{k}_" for k in range(len(bands))], [f"near_{k}_" for k in range(len(bands))]
    exact = [F.abs(F.col(x) - F.col(y)) < w for x, y, w in bands]
    same = [F.col(c) == F.col(n) for c, n in zip(cells, nears)]
    sizes = a.groupBy(*cells).agg(F.count("*").alias("left_")).join(b.groupBy(*nears).agg(F.count("*").alias("right_")), reduce(and_, same))
    sizes = cut(sizes.select(*(F.col(c).alias(f"size_{c}") for c in cells), (F.col("left_").cast("double") * F.col("right_")).alias("pairs_")))
    parts = int((sizes.agg(F.sum("pairs_")).first()[0] or 0) // PAIRS) + 1
    if parts == 1:
        return a.join(b, reduce(and_, same + exact)).drop(*cells, *nears)
    chunks = F.ceil(F.col("pairs_") / PAIRS).cast("long")
    met = lambda df, names: df.join(sizes, reduce(and_, (F.col(n) == F.col(f"size_{c}") for n, c in zip(names, cells)))).withColumn("chunks_", chunks).drop("pairs_", *(f"size_{c}" for c in cells))
    # written before they are dealt again, so that a task that runs twice deals the same rows
    a = cut(met(a, cells).withColumn("chunk_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("chunks_"))).drop("chunks_"))
    b = met(b, nears).withColumn("deal_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks_") - 1))).drop("chunks_")
    a, b = a.repartition(parts, *cells, "chunk_"), b.repartition(parts, *nears, "deal_")
    return a.join(b.hint("shuffle_hash"), reduce(and_, [*same, F.col("chunk_") == F.col("deal_"), *exact])).drop(*cells, *nears, "chunk_", "deal_")


def _reach(value, width: float):
    """For each value v the greatest double below v that isn't nearer than `width`, and the greatest that is: columns low, high. By bisection of the doubles, so the subtraction is rounded as in the comparison."""
    import numpy as np
    import pandas as pd

    v = value.to_numpy(np.float64)
    key = lambda x: np.where(x.view(np.int64) < 0, np.int64(-(2**63)) - x.view(np.int64), x.view(np.int64))  # noqa: E731  # in the order of the doubles
    real = lambda k: np.where(k < 0, np.int64(-(2**63)) - k, k).view(np.float64)
    most = np.full(len(v), np.finfo(np.float64).max)

    def edge(inner, outer):
        """The last of the doubles from inner to outer that is near, and the one beyond it."""
        while True:
            middle = inner // 2 + outer // 2 + (inner & outer & 1)
            open_ = (middle != inner) & (middle != outer)
            if not open_.any():
                return inner, outer
            near = np.abs(v - real(middle)) < width
            inner, outer = np.where(open_ & near, middle, inner), np.where(open_ & ~near, middle, outer)

    with np.errstate(over="ignore"):
        return pd.DataFrame({"low": real(edge(key(v), key(-most))[1]), "high": real(edge(key(v), key(most))[0])})


def band_counts(left: DataFrame, right: DataFrame, by: str, few: tuple[str, str, float], band: tuple[str, str, float]) -> DataFrame:
    """How many pairs `band_join` has for each value of a left column: by, pairs (groups without any are left out). No pair is made.

    `few` is a band over columns of few distinct values, such as keys of nations, whose pairs are joined; `band` is one over
    any numbers. Each left row asks how many right rows stand up to either end of its band. Right rows and ends are
    range-partitioned together; each partition adds up its own rows, and the sums of those before are added.
    """
    (d, e, near), (x, y, width) = few, band
    if not width > 0:
        return left.select(by, F.lit(0).cast("long").alias("pairs")).limit(0)
    number = lambda c: F.col(c).cast("double")
    real = lambda c: F.abs(number(c)) < float("inf")
    a = left.filter(real(x)).groupBy(F.col(by).alias("by_"), F.col(d).alias("d_"), number(x).alias("v_")).agg(F.count("*").alias("n_"))
    b = right.filter(real(y)).groupBy(F.col(e).alias("e_"), number(y).alias("at_")).agg(F.count("*").alias("n_"))
    like = a.select("d_").distinct().join(b.select("e_").distinct(), F.abs(F.col("d_") - F.col("e_")) < near)
    stands = b.join(F.broadcast(like), "e_").groupBy("d_", "at_").agg(F.sum("n_").alias("n_"))
    ends = F.pandas_udf(lambda v: _reach(v, width), "low double, high double")
    asks = a.withColumn("ends_", ends("v_")).select("by_", "d_", F.explode(F.array(F.struct(F.col("ends_.low").alias("at_"), (-F.col("n_")).alias("n_")), F.struct(F.col("ends_.high").alias("at_"), "n_"))).alias("end_"))
    asks = asks.groupBy("by_", "d_", "end_.at_").agg(F.sum("end_.n_").alias("asked_"))
    rows = stands.select("d_", "at_", F.lit(0).alias("kind_"), "n_").unionByName(asks.withColumn("kind_", F.lit(1)), allowMissingColumns=True)
    rows = cut(rows.repartitionByRange("d_", "at_", "kind_").withColumn("part_", F.spark_partition_id()))
    sums = rows.groupBy(F.col("d_").alias("group_"), F.col("part_").alias("in_")).agg(F.sum(F.coalesce("n_", F.lit(0))).alias("sum_"))  # a row for each partition of a group
    before = sums.select("group_", "in_", F.coalesce(F.sum("sum_").over(W.partitionBy("group_").orderBy("in_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    upto = F.coalesce(F.sum("n_").over(W.partitionBy("d_", "part_").orderBy("at_", "kind_").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    counted = rows.withColumn("upto_", upto).filter("kind_ = 1").join(F.broadcast(before), (F.col("d_") == F.col("group_")) & (F.col("part_") == F.col("in_")))
    return counted.groupBy(F.col("by_").alias(by)).agg(F.sum(F.col("asked_") * (F.col("upto_") + F.col("before_"))).alias("pairs")).filter("pairs > 0")


def as_of_validity(facts: DataFrame, versions: DataFrame, on: Pairs, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each fact with the version that was valid then: start <= at < end, an absent end being open."""
    keys = [facts[x] == versions[y] for x, y in on]
    return facts.join(versions, reduce(and_, keys) & (facts[at] >= versions[start]) & (versions[end].isNull() | (facts[at] < versions[end])))


def as_of_merge(facts: DataFrame, versions: DataFrame, on: Pairs, at: str, start: str = "valid_from", end: str = "valid_to", how: str = "inner") -> DataFrame:
    """The rows of `as_of_validity`, for versions of a key that don't overlap, without joining facts with versions.

    Both sides are one table, ordered by key and time, in which each fact takes the last version before it. The table is
    range-partitioned by key and time, so the rows of a hot key lie in many partitions; what a partition's first rows lack is
    the last version of an earlier one, of which there is one row a partition. A fact without key or time meets no version;
    of versions with one start the one that ends last counts; a version that ends where it starts holds nothing. how:
    inner, or left to keep facts without a version.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    key, none = [f"key_{k}_" for k in range(len(on))], F.lit(None)
    whole = lambda df: F.struct(*(F.col(c) for c in df.columns))
    held = versions.filter(F.col(end).isNull() | (F.col(start) < F.col(end)))
    a = facts.select(*(F.col(x).alias(k) for k, (x, _) in zip(key, on)), F.col(at).alias("time_"), F.lit(1).alias("kind_"), whole(facts).alias("fact_"))
    b = held.select(*(F.col(y).alias(k) for k, (_, y) in zip(key, on)), F.col(start).alias("time_"), F.lit(0).alias("kind_"), F.lit(True).alias("is_"), F.col(end).alias("end_"), whole(held).alias("version_"))
    a = a.select("*", none.cast("boolean").alias("is_"), none.cast(b.schema["end_"].dataType).alias("end_"), none.cast(b.schema["version_"].dataType).alias("version_"))
    b = b.dropna(subset=[*key, "time_"]).withColumn("fact_", none.cast(a.schema["fact_"].dataType))
    # an open version sorts behind the closed ones of its start, so that it is the last
    order = [*(F.col(k) for k in key), F.col("time_"), F.col("kind_"), F.col("end_").asc_nulls_last()]
    rows = cut(a.unionByName(b).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    within = W.partitionBy("part_", *key).orderBy(*order[len(key) :])
    rows = rows.withColumn("last_", F.last("version_", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy("part_").agg(F.max(F.struct(*key)).alias("key_"), F.count("*").alias("n_"))
    tail = F.max_by("version_", F.struct("time_", F.col("end_").isNull(), "end_"))
    lasts = rows.filter("is_").join(F.broadcast(ends), "part_").filter(F.struct(*key) == F.col("key_")).groupBy("part_").agg(F.first("key_").alias("key_"), tail.alias("tail_"))
    firsts = rows.groupBy("part_").agg(F.min(F.struct(*key)).alias("first_"))
    before = lasts.select(F.col("part_").alias("from_"), "key_", "tail_")
    carried = firsts.join(before, (F.col("first_") == F.col("key_")) & (F.col("from_") < F.col("part_"))).groupBy("part_").agg(F.first("first_").alias("first_"), F.max_by("tail_", "from_").alias("tail_"))
    found = rows.filter("kind_ = 1").join(F.broadcast(carried), "part_", "left")
    last = F.coalesce("last_", F.when(F.struct(*key) == F.col("first_"), F.col("tail_")))
    found = found.withColumn("last_", last).withColumn("last_", F.when(F.col(f"last_.{end}").isNull() | (F.col("time_") < F.col(f"last_.{end}")), F.col("last_")))
    if how == "inner":
        found = found.filter(F.col("last_").isNotNull())
    return found.select(*(F.col("fact_")[c].alias(c) for c in facts.columns), *(F.col("last_")[c].alias(c) for c in versions.columns))
