"""Write strategies on tables and Parquet folders, with receipts."""

from __future__ import annotations

import json
import time
from functools import reduce
from operator import and_

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut


def latest_rows(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by `order`. Without an order, repeated keys are an error when the plan runs."""
    by = W.partitionBy(*keys)
    if order:
        rank = F.row_number().over(by.orderBy(F.col(order).desc_nulls_last()))
        return df.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")
    n = F.count("*").over(by)
    fine = F.when(n > 1, F.raise_error(F.lit("repeated keys need an order column"))).otherwise(F.lit(True))
    return df.withColumn("fine_", fine.cast("boolean")).filter("fine_").drop("fine_")


def renamed(df: DataFrame, suffix: str = "_in_") -> DataFrame:
    """All columns under names of their own, so that a table can meet another made of the same source."""
    return df.select(*(F.col(c).alias(c + suffix) for c in df.columns))


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None, label: bool = False) -> DataFrame:
    """The target with rows of the source put in by key: all other columns of a matched row are replaced, the rest is added.

    If every column is a key, matched rows stay. Null keys match nothing. label adds action_ (kept, updated, inserted).
    """
    s = renamed(latest_rows(source.select(*target.columns), keys, order).withColumn("row", F.lit(True)))
    both = target.withColumn("was_", F.lit(True)).join(s, reduce(and_, (F.col(k) == F.col(f"{k}_in_") for k in keys)), "full")
    rest = [c for c in target.columns if c not in keys]
    action = F.when(F.col("row_in_").isNull(), "kept").when(F.col("was_").isNull(), "inserted").otherwise("updated" if rest else "kept")
    columns = [F.when(F.col("row_in_").isNotNull(), F.col(f"{c}_in_")).otherwise(F.col(c)).alias(c) for c in target.columns]
    return both.select(*columns, *([action.alias("action_")] if label else []))


def delete_insert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Deletes all target rows whose key is in the source, then adds every source row, repeats included. Null keys match nothing."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(source)


def insert_overwrite(target: DataFrame, source: DataFrame, partition: str) -> DataFrame:
    """Replaces the partitions that the source has; a null partition value in the source is an error."""
    checked = source.withColumn(partition, F.when(F.col(partition).isNull(), F.raise_error(F.lit("null partition value"))).otherwise(F.col(partition)))
    return target.join(source.select(partition).distinct(), partition, "left_anti").select(*target.columns).unionByName(checked)


def truncate_insert(target: DataFrame, source: DataFrame) -> DataFrame:
    return source.select(*target.columns)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source)


def with_new_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """Both tables by name; columns that only the source has are null in the target's rows."""
    return target.unionByName(source, allowMissingColumns=True)


def fan_in(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Several inputs of one node, by name."""
    return reduce(lambda a, b: a.unionByName(b), others, first)


def merge_receipt(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row: strategy, rows written, inserted, updated, kept."""
    n = lambda a: F.count_if(F.col("action_") == a)
    return merge(target, source, keys, order, True).agg(F.lit("merge").alias("strategy"), (n("inserted") + n("updated")).alias("rows_written"), n("inserted").alias("rows_inserted"), n("updated").alias("rows_updated"), n("kept").alias("rows_kept"))


#: Types that become a wider one without loss: (from, to).
WIDER = {(a, b) for kinds in (("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "double"), ("float", "double")) for k, a in enumerate(kinds) for b in kinds[k + 1 :]}


class ParquetTable:
    """A Parquet folder, with or without a partition column, that keeps the schema of its first write (columns may be added).

    merge and delete_insert rewrite only the files that hold a touched key; the others keep their names and times. New files
    are written aside first; then a journal names what comes and what goes, and both are done. A crash before the journal
    leaves the old table, one after it is made good at the next use (`recover`). While files change places a reader may see both.
    A whole rewrite goes to a folder beside the table, which is then put in its place; a crash between the two renames is
    mended likewise.
    """

    STRATEGIES = ("append", "truncate_insert", "merge", "delete_insert", "insert_overwrite")
    SCHEMA = "_schema.json"
    #: Distinct touched keys up to which they are put into the scan's filter as a list, so that statistics and Bloom filters of the files can rule it out.
    LISTED = 200

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = spark._jvm.org.apache.hadoop.fs.Path

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def _put(self, path: str, text: str) -> None:
        """A small file, whole or not at all."""
        out = self._fs.create(self._at(f"{path}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._at(path), False)
        self._fs.rename(self._at(f"{path}.tmp"), self._at(path))

    def _text(self, path: str) -> str:
        opened = self._fs.open(self._at(path))
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def recover(self) -> None:
        """Ends what was cut off: a journal is carried out; after a whole rewrite the new folder takes the empty place, else the old one goes back."""
        aside, old = f"{self.path}.new", f"{self.path}.old"
        if self._there(old):
            if not self._there(self.path):
                self._fs.rename(self._at(aside if self._there(f"{aside}/_SUCCESS") else old), self._at(self.path))
            self._fs.delete(self._at(old), True)
        if self._there(f"{self.path}.journal"):
            self._carry_out()

    def exists(self) -> bool:
        self.recover()
        return self._there(self.path)

    def schema(self) -> T.StructType:
        at = f"{self.path}/{self.SCHEMA}"
        if self._there(f"{at}.tmp") and not self._there(at):  # cut off just before its renaming
            self._fs.rename(self._at(f"{at}.tmp"), self._at(at))
        return T.StructType.fromJson(json.loads(self._text(at))) if self._there(at) else self.spark.read.parquet(self.path).schema

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.read.schema(self.schema()).parquet(self.path)

    def replace(self, df: DataFrame, partition: str | None = None, **options) -> None:
        aside, old = f"{self.path}.new", f"{self.path}.old"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(aside, **options)
        self._put(f"{aside}/{self.SCHEMA}", df.schema.json())
        if self.exists():
            self._fs.rename(self._at(self.path), self._at(old))
        self._fs.rename(self._at(aside), self._at(self.path))
        self._fs.delete(self._at(old), True)

    def touched(self, df: DataFrame, keys: list[str]) -> list[str]:
        """The files that hold a key of `df`: a row for each file is collected.

        Only key columns are read. The least and greatest key, and a short list of keys, reach the scan, where the statistics
        and Bloom filters of the files' footers rule out row groups.
        """
        wanted = df.select(*keys).dropna().distinct()
        plain = [k for k in keys if not isinstance(df.schema[k].dataType, (T.BinaryType, T.ArrayType, T.StructType))]
        ends = wanted.agg(F.lit(0), *(f(k).cast("string").alias(f"{n}_{k}") for k in plain for n, f in (("low", F.min), ("high", F.max)))).first()
        rows = self.read().select(*keys, F.col("_metadata.file_path").alias("file_"))
        value = lambda k, text: F.lit(text).cast(df.schema[k].dataType)  # noqa: E731  # text brings any value to the driver and back unchanged
        for k in plain:
            rows = rows.filter(F.col(k).between(value(k, ends[f"low_{k}"]), value(k, ends[f"high_{k}"])))
        if len(keys) == 1 and plain:
            some = [r[0] for r in wanted.select(F.col(keys[0]).cast("string")).limit(self.LISTED + 1).collect()]
            if len(some) <= self.LISTED:
                rows = rows.filter(F.col(keys[0]).isin([value(keys[0], v) for v in some]))
        return [r[0] for r in rows.join(wanted, keys, "left_semi").select("file_").distinct().collect()]

    def _rewrite(self, rows: DataFrame, gone: list[str], partition: str | None, keys: list[str]) -> None:
        """Puts rows in the place of some files."""
        aside = f"{self.path}.add"
        writer = rows.write.mode("overwrite")
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        (writer.partitionBy(partition) if partition else writer).parquet(aside)
        root = self._at(aside).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString()
        new, found = [], self._fs.listFiles(self._at(aside), True)
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().startswith("part-"):
                new.append(at.toString()[len(root) + 1 :])
        self._put(f"{self.path}.journal", json.dumps({"new": new, "gone": gone}))
        self._carry_out()

    def _carry_out(self) -> None:
        """What the journal says. Doing it again changes nothing."""
        todo = json.loads(self._text(f"{self.path}.journal"))
        for name in todo["new"]:
            source, target = self._at(f"{self.path}.add/{name}"), self._at(f"{self.path}/{name}")
            if self._fs.exists(source):
                self._fs.mkdirs(target.getParent())
                self._fs.rename(source, target)
        for name in todo["gone"]:
            self._fs.delete(self._at(self.spark._jvm.java.net.URI(name)), False)
        self._fs.delete(self._at(f"{self.path}.add"), True)
        self._fs.delete(self._at(f"{self.path}.journal"), False)

    def _partition(self) -> str | None:
        """The partition column, told by the names of the folders."""
        for f in self._fs.listStatus(self._at(self.path)):
            if f.isDirectory() and "=" in f.getPath().getName():
                return f.getPath().getName().split("=")[0]
        return None

    def _fitted(self, df: DataFrame, strategy: str, known: T.StructType, add_columns: bool) -> DataFrame:
        """`df` with the table's columns in order, null where it lacks one. New columns are added to the table's schema if that is allowed."""
        types = {f.name: f.dataType for f in known}
        if strategy == "truncate_insert":
            return df
        wider = {f.name: types[f.name] for f in df.schema if f.name in types and f.dataType.simpleString() != types[f.name].simpleString()}
        if changed := [c for c, t in wider.items() if (df.schema[c].dataType.simpleString(), t.simpleString()) not in WIDER]:
            raise ValueError(f"columns of another type: {changed}")
        df = df.withColumns({c: F.col(c).cast(t) for c, t in wider.items()})
        if strategy == "merge" and not add_columns:
            df = df.select(*(c for c in df.columns if c in types))
        more = [f for f in df.schema if f.name not in types]
        if more and not add_columns:
            raise ValueError(f"the table has no columns {[f.name for f in more]}")
        if more:
            self._put(f"{self.path}/{self.SCHEMA}", T.StructType([*known, *(T.StructField(f.name, f.dataType) for f in more)]).json())
        lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in known if f.name not in df.columns]
        return df.select("*", *lacking).select(*(f.name for f in known), *(f.name for f in more))

    def write(self, df: DataFrame, strategy: str, keys: list[str] | None = None, order: str | None = None, partition: str | None = None, add_columns: bool = False, watermark: str | None = None, observed: bool = True) -> dict | None:
        """Writes by a strategy; gives a receipt. An empty first write of any kind makes the table.

        The receipt has strategy, mode (batch), rows_scanned (of `df`), rows_written, rows_inserted, rows_updated,
        rows_deleted (None where replaced partitions aren't counted), rows_filtered (scanned, not written),
        watermark_before and watermark_after (the greatest value of the column `watermark`), schema_diff, files_rewritten (None
        where the whole table is written or files are only added) and duration_s. Columns that the table lacks are an error
        unless add_columns (merge leaves them out); those that `df` lacks are null in its rows. Narrower numbers become the
        table's type, any other type is an error; truncate_insert takes the columns and types of `df`.
        All counts are observed while the rows are written, so the plan runs once. Without `observed` (batches of a stream,
        whose sessions report nothing) there is no receipt.
        """
        if strategy not in self.STRATEGIES:
            raise ValueError(f"no such strategy: {strategy}")
        if strategy in ("merge", "delete_insert") and not keys:
            raise ValueError(f"{strategy} needs keys")
        if strategy == "insert_overwrite" and not partition:
            raise ValueError("insert_overwrite needs a partition column")
        began, new = time.monotonic(), not self.exists()
        top = F.max(watermark).cast("string") if watermark else F.lit(None).cast("string")
        old = None if new else self.read()
        receipt = {"strategy": strategy, "mode": "batch", "rows_inserted": 0, "rows_updated": 0, "rows_deleted": 0, "schema_diff": [], "watermark_before": None, "files_rewritten": None}
        if old is not None:
            was, now = dict(old.dtypes), dict(df.dtypes)
            receipt["schema_diff"] = [(c, "added" if c not in was else "removed" if c not in now else "type_changed") for c in sorted(was.keys() | now.keys()) if was.get(c) != now.get(c)]
            receipt["watermark_before"] = old.agg(top).first()[0] if watermark in old.columns else None  # from the footers, where they have it
            df = self._fitted(df, strategy, old.schema, add_columns)
        if partition:
            df = df.withColumn(partition, F.when(F.col(partition).isNull(), F.raise_error(F.lit("null partition value")).cast(df.schema[partition].dataType)).otherwise(F.col(partition)))
        scan, done, gone = Observation(), Observation(), None
        df = df.observe(scan, F.count(F.lit(1)).alias("n"), top.alias("top")) if observed else df
        if strategy in ("merge", "delete_insert") and not new:
            df = cut(df)  # its keys are asked for before its rows are written
            gone = self.touched(df, keys)
            files = [self._at(self.spark._jvm.java.net.URI(f)).toString() for f in gone]
            old = self.spark.read.schema(self.schema()).option("basePath", self.path).parquet(*files) if files else self.read().filter(F.lit(False))
            receipt["files_rewritten"] = len(gone)
        count = lambda c: F.count_if(F.col("action_") == c).alias(c)
        if strategy == "merge":
            rows = latest_rows(df, keys, order).withColumn("action_", F.lit("inserted")) if new else merge(old, df, keys, order, True)
        elif strategy == "delete_insert" and not new:
            there = renamed(df.select(*keys).distinct()).withColumn("gone_", F.lit(True))
            kept = old.join(there, reduce(and_, (F.col(k) == F.col(f"{k}_in_") for k in keys)), "left").select(*old.columns, F.when(F.col("gone_"), "deleted").otherwise("kept").alias("action_"))
            rows = kept.unionByName(df.withColumn("action_", F.lit("inserted")))
        else:
            rows = df.withColumn("action_", F.lit("inserted"))
            if strategy == "truncate_insert" and not new:
                receipt["rows_deleted"] = old.count()  # from the footers
                rows = rows.select(*(c for c in old.columns if c in df.columns), *(c for c in df.columns if c not in old.columns), "action_")
        rows = rows.observe(done, *map(count, ("inserted", "updated", "deleted"))) if observed else rows
        rows = rows.filter("action_ <> 'deleted'").drop("action_")
        try:
            if strategy == "insert_overwrite" and not new:
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(self.path)
            elif gone is not None:
                self._rewrite(rows, gone, partition or self._partition(), keys)
            elif strategy == "append" and not new:
                writer = rows.write.mode("append")
                (writer.partitionBy(partition) if partition else writer).parquet(self.path)
            else:
                self.replace(rows, partition)
        except PySparkException as e:
            if "null partition value" in str(e):
                raise ValueError("null partition value") from e
            raise
        if not observed:
            return None
        seen, made = scan.get, done.get
        receipt |= {f"rows_{k}": made[k] for k in ("inserted", "updated")}
        receipt["rows_deleted"] = None if strategy == "insert_overwrite" and not new else receipt["rows_deleted"] + made["deleted"]
        written = made["inserted"] + made["updated"]
        return receipt | {"rows_scanned": seen["n"], "rows_written": written, "rows_filtered": seen["n"] - written, "watermark_after": seen["top"], "duration_s": time.monotonic() - began}
