"""Incremental reads with a stored high-water mark, and schema drift."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType), "int64": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "string": (T.StringType,)}


def lookback(text: str | None) -> timedelta:
    """An ISO-8601 duration of days to seconds."""
    if not text:
        return timedelta(0)
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    d, h, mi, s = (int(x or 0) for x in m.groups())
    return timedelta(days=d, hours=h, minutes=mi, seconds=s)


def check_kind(df: DataFrame, column: str, kind: str) -> None:
    if kind not in KINDS or not isinstance(df.schema[column].dataType, KINDS[kind]):
        raise ValueError(f"{column} can't be a watermark of kind {kind}")


def incremental_filter(df: DataFrame, column: str, stored, kind: str = "timestamp", back: str | None = None) -> DataFrame:
    """Rows above the stored value less the lookback. Without a stored value all rows; with one, nulls go. The filter reaches the scan."""
    check_kind(df, column, kind)
    if back and kind != "timestamp":
        raise ValueError("a lookback needs a timestamp watermark")
    if stored is None:
        return df
    return df.filter(F.col(column) > F.lit(stored - lookback(back) if kind == "timestamp" else stored).cast(df.schema[column].dataType))


def max_watermark(df: DataFrame, column: str) -> DataFrame:
    """The greatest value, and its canonical text (nine digits of a second, UTC); null if there is none."""
    top = F.max(column)
    kind = df.schema[column].dataType
    text = F.concat(F.date_format("watermark", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z")) if isinstance(kind, KINDS["timestamp"]) else F.col("watermark").cast("string")
    return df.agg(top.alias("watermark")).withColumn("canonical", text)


def shared_watermarks(states: DataFrame) -> DataFrame:
    """For each source of several sinks: the least stored value, typed; none if a sink has no state; the greatest lookback.

    states: source, sink, watermark_column, value, lookback_seconds. Sinks that differ in the column, or in its type where states have
    watermark_type, are an error.
    """
    same = F.count_distinct("watermark_column") == 1
    if "watermark_type" in states.columns:
        same = same & (F.count_distinct("watermark_type") <= 1)
    least = F.when(F.count_if(F.col("value").isNull()) == 0, F.min("value"))
    ok = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("sinks of one source differ in their watermark column")).cast("boolean"))
    return states.groupBy("source").agg(least.alias("value"), F.max("lookback_seconds").alias("lookback_seconds"), ok.alias("ok")).filter("ok").drop("ok")


def schema_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that were added, removed or changed in type: name, change, old_type, new_type."""
    a, b = schema_table(before).select("name", F.col("type").alias("old_type")), schema_table(after).select("name", F.col("type").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("type_changed")
    return a.join(b, "name", "full").filter(~F.col("old_type").eqNullSafe(F.col("new_type"))).select("name", change.alias("change"), "old_type", "new_type")


def schema_fingerprint(df: DataFrame) -> DataFrame:
    """SHA-256 of the sorted name and type pairs."""
    pair = F.concat_ws("\x1f", "name", "type")
    return schema_table(df).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\x1e").cast("binary"), 256).alias("fingerprint"))


POLICIES = ("fail", "ignore", "append_new_columns", "sync_all_columns")


def drift_actions(diff: DataFrame, policy: str) -> DataFrame:
    """What a policy does on each change of `schema_diff`: proceed, alter (the target gets or loses the column) or abort; adds action.

    ignore proceeds with all; fail aborts at any change; the others abort at a changed type, alter for an added column and
    proceed without a removed one (sync_all_columns alters for it). Another policy is an error.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such drift policy: {policy}")
    removed = "alter" if policy == "sync_all_columns" else "proceed"
    rest = F.when(F.col("change") == "type_changed", "abort").when(F.col("change") == "added", "alter").otherwise(removed)
    return diff.withColumn("action", F.lit({"ignore": "proceed", "fail": "abort"}[policy]) if policy in ("ignore", "fail") else rest)


def drift_action(diff: DataFrame, policy: str) -> str:
    """The action for all changes together: abort before alter before proceed."""
    found = {r["action"] for r in drift_actions(diff, policy).select("action").distinct().collect()}  # three actions at most
    return next((a for a in ("abort", "alter") if a in found), "proceed")


def drift_allowed(diff: DataFrame, policy: str) -> bool:
    """Whether a change may go on."""
    return drift_action(diff, policy) != "abort"
