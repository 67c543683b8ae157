"""Run analytics: windows, failures, freshness and comparison. Times are milliseconds; now is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ["success", "failed", "running", "pending", "cancelled"]


def in_window(runs: DataFrame, since: int) -> DataFrame:
    return runs.filter((F.col("start_ms") >= since) | (F.col("start_ms").isNull() & F.col("status").isin("pending", "running")))


def status_counts(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def top_failing(runs: DataFrame, k: int = 10) -> DataFrame:
    failed = runs.filter("status = 'failed'").groupBy("pipeline").agg(F.count("*").alias("failures"), F.max_by("error", F.struct("end_ms", "id")).alias("last_error"))
    return failed.orderBy(F.desc("failures"), "pipeline").limit(k)


def slowest(runs: DataFrame, k: int = 10) -> DataFrame:
    """Whole milliseconds on average, over successful runs."""
    took = F.col("end_ms") - F.col("start_ms")
    out = runs.filter("status = 'success'").groupBy("pipeline").agg(F.expr("sum(end_ms - start_ms) div count(end_ms - start_ms)").alias("mean_ms"), F.max(took).alias("max_ms"))
    return out.orderBy(F.desc("mean_ms"), "pipeline").limit(k)


def first_failures(runs: DataFrame) -> DataFrame:
    """The earliest failure of each pipeline that had a success before it, in order of start."""
    before = W.partitionBy("pipeline").orderBy("start_ms", "id").rowsBetween(W.unboundedPreceding, -1)
    well = F.max((F.col("status") == "success").cast("int")).over(before)
    broke = runs.withColumn("well", well).filter("status = 'failed' and well = 1")
    return broke.groupBy("pipeline").agg(F.min_by("id", F.struct("start_ms", "id")).alias("run_id"), F.min("start_ms").alias("start_ms"))


def sla(notes: DataFrame, producers: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Freshness of each annotated resource: ok, warning, breach, or unknown without a successful run.

    notes: resource, max_age_ms, warn_ms; producers: resource, pipeline.
    """
    last = runs.filter("status = 'success'").groupBy("pipeline").agg(F.max("end_ms").alias("end_ms"))
    fresh = producers.join(last, "pipeline").groupBy("resource").agg(F.max("end_ms").alias("last_success_ms"))
    age = F.lit(now) - F.col("last_success_ms")
    status = F.when(F.col("last_success_ms").isNull(), "unknown").when(age > F.col("max_age_ms"), "breach").when(age > F.col("warn_ms"), "warning").otherwise("ok")
    return notes.join(fresh, "resource", "left").select("resource", "last_success_ms", age.alias("age_ms"), status.alias("status"))


def latest_per(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The rows of the latest time of each key, ties kept."""
    return rows.withColumn("last_", F.max(at).over(W.partitionBy(key))).filter(F.col(at) == F.col("last_")).drop("last_")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs by node: durations and rows of both, the differences, and where a node ran."""
    x = a.select("node", F.col("duration_ms").alias("a_ms"), F.col("rows").alias("a_rows"))
    y = b.select("node", F.col("duration_ms").alias("b_ms"), F.col("rows").alias("b_rows"))
    where = F.when(F.col("a_ms").isNull(), "only_b").when(F.col("b_ms").isNull(), "only_a").otherwise("both")
    return x.join(y, "node", "full").select("node", "a_ms", "b_ms", (F.col("b_ms") - F.col("a_ms")).alias("delta_ms"), (F.col("b_rows") - F.col("a_rows")).alias("delta_rows"), where.alias("presence"))


def compare_tests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outcomes of tests in two runs; an absent one differs from a failed one."""
    x, y = a.select("test", F.col("passed").alias("a_passed")), b.select("test", F.col("passed").alias("b_passed"))
    return x.join(y, "test", "full").withColumn("changed", ~F.col("a_passed").eqNullSafe(F.col("b_passed")))


def failure_sample(rows: DataFrame, n: int = 25, key: str | None = None) -> DataFrame:
    """Up to n input rows as JSON (500 at most), the first by the key."""
    some = (rows.orderBy(key) if key else rows).limit(min(n, 500))
    return some.select(F.to_json(F.struct("*")).alias("row"))


def failure_report(inputs: dict[str, DataFrame], n: int = 25, keys: dict[str, str] | None = None) -> DataFrame:
    """For each input of a failed node: input, total_rows, schema, and a sample of rows as JSON (an array, by the key if there is one)."""
    out = []
    for name, rows in inputs.items():
        sample = failure_sample(rows, n, (keys or {}).get(name)).agg(F.array_sort(F.collect_list("row")).alias("sample"))  # at most 500 rows
        total = rows.agg(F.lit(name).alias("input"), F.count("*").alias("total_rows"), F.lit(rows.schema.simpleString()).alias("schema"))
        out.append(total.join(F.broadcast(sample)))
    return reduce(DataFrame.unionByName, out)
