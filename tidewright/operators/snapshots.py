"""Slowly changing history: every version of a key with its interval of validity."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writes import latest_rows, renamed

META = ("scd_id", "valid_from", "valid_to", "is_current")


def business_columns(target: DataFrame) -> list[str]:
    return [c for c in target.columns if c not in META]


def signal(target: DataFrame, keys: list[str], check: list[str] | str | None, updated_at: str | None) -> list[str]:
    """The columns whose difference means a change: the timestamp alone, the listed ones, or with * all but the keys."""
    if updated_at:
        return [updated_at]
    return [c for c in business_columns(target) if c not in keys] if check == "*" else list(check)


def classify(target: DataFrame, stage: DataFrame, keys: list[str], check: list[str] | str | None = "*", updated_at: str | None = None, order: str | None = None) -> DataFrame:
    """Current rows (c) and staged rows (s) by key, null keys equal: class is unchanged, changed, new or gone."""
    columns = business_columns(target)
    c = target.filter("is_current").withColumn("was_", F.lit(True))
    s = renamed(latest_rows(stage.select(*columns), keys, order).withColumn("row", F.lit(True)))
    both = c.join(s, reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_in_")) for k in keys)), "full")
    changed = reduce(or_, (~F.col(x).eqNullSafe(F.col(f"{x}_in_")) for x in signal(target, keys, check, updated_at)), F.lit(False))
    kind = F.when(F.col("was_").isNull(), "new").when(F.col("row_in_").isNull(), "gone").when(changed, "changed").otherwise("unchanged")
    return both.select(kind.alias("class"), F.struct(*(F.col(x) for x in (*columns, *META))).alias("c"), F.struct(*(F.col(f"{x}_in_").alias(x) for x in columns)).alias("s"))


def scd_id(now: Column, keys: list[Column]) -> Column:
    """Digest of the time (to the microsecond) and the keys. Each key carries its length, and null is told from any text."""
    part = lambda k: F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", F.date_format(now, "yyyy-MM-dd HH:mm:ss.SSSSSS"), *map(part, keys)).cast("binary"))


def first_snapshot(stage: DataFrame, keys: list[str], now) -> DataFrame:
    """The first version of every key."""
    at = F.lit(now).cast("timestamp_ntz")
    return stage.select("*", scd_id(at, [F.col(k) for k in keys]).alias("scd_id"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))


def apply_snapshot(target: DataFrame, stage: DataFrame, keys: list[str], now, check: list[str] | str | None = "*", updated_at: str | None = None, hard_deletes: str = "ignore", partial: bool = False, order: str | None = None) -> DataFrame:
    """The target after a snapshot: changed rows are closed and opened anew, new ones opened, history kept.

    hard_deletes: ignore keeps the current row of a gone key, invalidate closes it, delete drops all its versions. A partial
    (incremental) stage can't tell gone keys, so it takes ignore only.
    """
    if hard_deletes not in ("ignore", "invalidate", "delete"):
        raise ValueError(hard_deletes)
    if partial and hard_deletes != "ignore":
        raise ValueError("a partial stage can't tell which keys are gone")
    columns = business_columns(target)
    at = F.lit(now).cast("timestamp_ntz")
    rows = classify(target, stage, keys, check, updated_at, order)
    closing = F.col("class") == "changed" if hard_deletes == "ignore" else F.col("class").isin("changed", "gone")
    kept = rows.filter(F.col("class") != "new")
    if hard_deletes == "delete":
        kept = kept.filter(F.col("class") != "gone")
    old = kept.select(*(F.col(f"c.{x}") for x in (*columns, "scd_id", "valid_from")), F.when(closing, at).otherwise(F.col("c.valid_to")).alias("valid_to"), (~closing).alias("is_current"))
    new = rows.filter(F.col("class").isin("new", "changed")).select("s.*")
    history = target.filter("not is_current")
    if hard_deletes == "delete":
        gone = rows.filter("class = 'gone'").select(*(F.col(f"c.{k}").alias(f"gone_{k}_") for k in keys))
        history = history.join(gone, reduce(and_, (history[k].eqNullSafe(gone[f"gone_{k}_"]) for k in keys)), "left_anti")
    return history.unionByName(old).unionByName(first_snapshot(new, keys, now)).select(*target.columns)


def as_of(target: DataFrame, at) -> DataFrame:
    """The versions valid at a time."""
    t = F.lit(at).cast("timestamp_ntz")
    return target.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def history_of(target: DataFrame, **key) -> DataFrame:
    """All versions of one key, newest first."""
    return target.filter(reduce(and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()))).orderBy(F.col("valid_from").desc())


def versions_per_day(target: DataFrame) -> DataFrame:
    return target.groupBy(F.date_trunc("day", "valid_from").alias("day")).agg(F.count("*").alias("versions"))


def ever_held(target: DataFrame, keys: list[str], column: str, value) -> DataFrame:
    """Keys of which any version held the value."""
    return target.filter(F.col(column).eqNullSafe(F.lit(value))).select(*keys).distinct()


def diff_sample(rows: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """At most `most` keys that aren't unchanged, the first by key: class and the keys."""
    at = lambda k: F.when(F.col("class") == "gone", F.col(f"c.{k}")).otherwise(F.col(f"s.{k}")).alias(k)
    return rows.filter("class <> 'unchanged'").select("class", *map(at, keys)).orderBy(*keys).limit(most)


def diff_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def roll_up(rows: DataFrame, hard_deletes: str = "ignore") -> DataFrame:
    """Receipt: inserted = new + changed; updated = changed + closed; deleted = current rows dropped."""
    n = lambda c: F.count_if(F.col("class") == c)
    gone = n("gone")
    return rows.agg((n("new") + n("changed")).alias("inserted"), (n("changed") + (gone if hard_deletes == "invalidate" else F.lit(0))).alias("updated"), (gone if hard_deletes == "delete" else F.lit(0)).cast("long").alias("deleted"))
