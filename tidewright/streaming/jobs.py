"""Structured Streaming versions of the incremental jobs."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import file_parts
from ..operators.assertions import Rule, run_suite
from ..operators.shared import cut
from ..operators.snapshots import apply_snapshot, first_snapshot
from ..operators.writes import ParquetTable, renamed


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """Files as they arrive; the checkpoint is the set of files seen."""
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path)


def event_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    """A watermark on a time column; one without a zone is read as UTC first."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def window_counts(stream: DataFrame, column: str, size: str, *by: str) -> DataFrame:
    """Events in windows of event time."""
    w = F.window(column, size)
    return stream.groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def deduplicated(stream: DataFrame, column: str, late: str, *keys: str) -> DataFrame:
    """Drops repeats that come within the watermark."""
    return event_time(stream, column, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, checkpoint: str, each, mode: str = "append") -> None:
    """Works through all there is, a batch at a time: each(batch, batch id)."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def merge_into(table: ParquetTable, keys: list[str], order: str | None = None):
    """For run_available: merges a batch, so that a batch that comes again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        table.write(batch, "merge", keys, order, observed=False)

    return each


def snapshot_into(table: ParquetTable, keys: list[str], updated_at: str):
    """For run_available: history by the batch's latest change of each key; gone keys can't be told.

    Only the current versions of the batch's keys are read, and only what changes is written: the versions that end and those
    that begin, by their surrogate ids. Files without any of them stay as they are.
    """

    def each(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max(updated_at)).first()[0] or datetime(1970, 1, 1)
        if not table.exists():
            table.replace(first_snapshot(batch, keys, now))
            return
        old = table.read().filter("is_current")
        came = renamed(batch.select(*keys).distinct())
        current = cut(old.join(came, reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_in_")) for k in keys)), "left_semi"))
        after = apply_snapshot(current, batch, keys, now, check=None, updated_at=updated_at, partial=True, order=updated_at)
        same = current.select(F.col("scd_id").alias("same_"))
        changed = after.join(same, (F.col("scd_id") == F.col("same_")) & F.col("is_current"), "left_anti")
        table.write(changed, "merge", ["scd_id"], observed=False)

    return each


def append_into(table: ParquetTable):
    """For run_available: adds a batch under its number, so that a batch that comes again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        table.write(batch.withColumn("batch_", F.lit(number)), "insert_overwrite", partition="batch_", observed=False)

    return each


def check_into(rules: list[Rule], results: ParquetTable, quarantine: ParquetTable):
    """For run_available: notes each batch's suite and puts its bad rows aside. A batch that comes again replaces what it left."""

    def each(batch: DataFrame, number: int) -> None:
        append_into(results)(run_suite(batch, rules), number)
        bad = F.lit(False)
        for r in rules:
            if r.bad is not None:
                bad = bad | F.coalesce(r.bad, F.lit(False))
        append_into(quarantine)(batch.filter(bad), number)

    return each


#: Groups of keys that share a state. A call of a group costs some milliseconds, so a key can't have one of its own.
KEY_GROUPS = 1024


class LateRows(StatefulProcessor):
    """Tells rows that come behind the watermark from those in time, and drops repeats of a key.

    The state of a group of keys (column key_) holds the time of each key's first row, until the watermark has passed it: later
    repeats are late anyway. A late row goes on with late_ = true whether its key is known or not, so none is lost.
    """

    def __init__(self, column: str) -> None:
        self.column = column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "keys binary")

    def handleInputRows(self, key, rows, timerValues):
        import pickle

        import pandas as pd

        behind = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        known = pickle.loads(bytes(self.seen.get()[0])) if self.seen.exists() else {}
        known = {k: at for k, at in known.items() if at >= behind.value}
        for batch in rows:
            late = batch[self.column].isna() | (batch[self.column] < behind)
            new = batch[~late & ~batch["key_"].isin(known)].sort_values(self.column, kind="stable").drop_duplicates("key_")
            known.update(zip(new["key_"], new[self.column].astype("datetime64[ns]").astype("int64")))
            yield batch.assign(late_=late)[late | batch.index.isin(new.index)].drop(columns=["key_", "group_"])
        self.seen.update((pickle.dumps(known),))

    def close(self) -> None:
        pass


def with_lateness(stream: DataFrame, column: str, late: str, *keys: str) -> DataFrame:
    """Rows of a stream with late_: whether their time is behind the watermark, which is `late` behind the latest time of the batches before.

    Spark drops rows behind a watermark before it works on them. Here the watermark stands on a copy of the column that goes
    no further, so late rows reach the state too (transformWithState), and can be put aside. Rows in time are kept once
    for each value of `keys`, whose states lie together in KEY_GROUPS groups. A row without time is late. Needs the RocksDB
    state store (`with_rocksdb`).
    """
    kind = stream.schema[column].dataType
    named = stream.withColumn(column, F.col(column).cast("timestamp"))
    marked = named.withColumn("watermark_", F.coalesce(column, F.timestamp_seconds(F.lit(0)))).withWatermark("watermark_", late).drop("watermark_")
    schema = T.StructType([*marked.schema, T.StructField("late_", T.BooleanType())])
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    marked = marked.withColumn("key_", F.to_json(F.struct(*keys), exact)).withColumn("group_", F.pmod(F.xxhash64("key_"), F.lit(KEY_GROUPS)))
    out = marked.groupBy("group_").transformWithStateInPandas(LateRows(column), schema, "append", "eventTime")
    return out.withColumn(column, F.col(column).cast(kind))


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def split_late_into(table: ParquetTable, aside: ParquetTable):
    """For run_available on `with_lateness`: rows in time are added to a table, late ones to another, each batch under its number."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            append_into(table)(rows.filter("not late_").drop("late_"), number)
            append_into(aside)(rows.filter("late_").drop("late_"), number)
        finally:
            rows.unpersist()

    return each


def arrival_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Files at a path or glob as they arrive, their contents unread: file_path, file_name, file_dir, file_ext, length, modified. The checkpoint is the set of files seen."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    found = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path)
    at = F.col("_metadata.file_path")
    return found.select(at.alias("file_path"), *(c.alias(n) for n, c in file_parts(at).items()), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))


def arrivals_into(files: ParquetTable, batches: ParquetTable):
    """For run_available on `arrival_stream`: notes each file under its batch, and of each batch file_count, the sorted file_paths, and the parts of the first one.

    A batch that comes again replaces what it left.
    """

    def each(batch: DataFrame, number: int) -> None:
        append_into(files)(batch, number)
        now = files.read().filter(F.col("batch_") == number)
        first = F.min_by(F.struct("file_path", "file_name", "file_dir", "file_ext"), "file_path")
        summary = now.agg(F.count("*").alias("file_count"), F.array_sort(F.collect_list("file_path")).alias("file_paths"), first.alias("first_")).filter("file_count > 0")
        append_into(batches)(summary.select("file_count", "file_paths", "first_.*"), number)

    return each
