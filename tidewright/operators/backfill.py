"""Backfills over ranges and lists, as one job."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = {"hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def range_iterations(spark: SparkSession, start: datetime, end: datetime, step: str) -> DataFrame:
    """Half-open iterations (iteration, start, end); the last ends at `end`. Months step to the first of the next month."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    first = F.date_trunc("month", s).cast("timestamp_ntz") if step == "month" else s
    marks = spark.range(1).select(F.explode(F.sequence(first, e, F.expr(STEPS[step]))).alias("mark")).filter(F.col("mark") < e)
    nxt = (F.col("mark") + F.expr(STEPS[step])).cast("timestamp_ntz")
    rows = marks.select(F.greatest("mark", s).alias("start"), F.least(nxt, e).alias("end")).filter(F.col("start") < F.col("end"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("iteration"), "start", "end")


def list_iterations(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in enumerate(values)], "position int, value string")


def query_iterations(df: DataFrame) -> DataFrame:
    """An iteration a row; its key is the first column."""
    return df.withColumn("iteration", F.col(df.columns[0]).cast("string"))


def assign(facts: DataFrame, iterations: DataFrame, at: str) -> DataFrame:
    """Facts with the iteration that holds their time (start <= time < end). Iterations may overlap and differ in length.

    An iteration stands on each day that it touches, so the join has an equal key, whatever the number of either side.
    """
    day = lambda c: F.to_date(c)
    days = iterations.withColumn("day_", F.explode(F.sequence(day(F.col("start")), day(F.col("end")), F.expr("interval 1 day"))))
    held = (facts[at] >= days["start"]) & (facts[at] < days["end"])
    return facts.join(days, (day(facts[at]) == days["day_"]) & held).drop("day_")


def placeholders(text: str, iterations: DataFrame) -> str:
    """An expression in which $iteration.start, .end, .value or any other column of the iterations stands for that column. An unknown name is an error."""

    def column(m: re.Match) -> str:
        if m[1] not in iterations.columns:
            raise ValueError(f"unknown placeholder: $iteration.{m[1]}")
        return f"`{m[1]}`"

    return re.sub(r"\$iteration\.(\w+)", column, text)


def pending(iterations: DataFrame, status: DataFrame) -> DataFrame:
    """Iterations that haven't succeeded."""
    return iterations.join(status.filter("status = 'succeeded'").select("iteration"), "iteration", "left_anti")


def progress(status: DataFrame) -> DataFrame:
    return status.groupBy().pivot("status", ["pending", "running", "succeeded", "failed"]).agg(F.count(F.lit(1)))
