"""Tables that keep their schema and rewrite only touched files, as-of joins by merging, late rows, arrivals and layouts."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators.joins import as_of_merge, as_of_validity
from tidewright.operators.writes import ParquetTable
from tidewright.streaming import jobs


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_partition_values_stay_text(spark, tmp_path):
    t = ParquetTable(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "k int, p string")
    t.write(make([(1, "001"), (2, "02")]), "append", partition="p")
    assert values(t.read()) == [(1, "001"), (2, "02")]
    t.write(make([(3, "03"), (1, "1e3")]), "merge", ["k"], partition="p")
    t.write(make([(4, "001")]), "append", partition="p")
    assert values(t.read()) == [(1, "1e3"), (2, "02"), (3, "03"), (4, "001")]
    t.write(make([(5, "02")]), "insert_overwrite", partition="p")
    assert t.read().schema["p"].dataType.simpleString() == "string" and values(t.read().filter("p = '02'")) == [(5, "02")]


def test_append_keeps_the_schema(spark, tmp_path):
    t = ParquetTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a")], "k bigint, v string"), "append")
    with pytest.raises(ValueError, match="no columns"):
        t.write(spark.createDataFrame([(2, "b", 3)], "k bigint, v string, more int"), "append")
    with pytest.raises(ValueError, match="another type"):
        t.write(spark.createDataFrame([("x", "b")], "k string, v string"), "append")
    t.write(spark.createDataFrame([("b", 2)], "v string, k int"), "append")
    t.write(spark.createDataFrame([(3,)], "k bigint"), "append")
    got = t.write(spark.createDataFrame([(4, "d", 9)], "k bigint, v string, more int"), "append", add_columns=True)
    assert got["schema_diff"] == [("more", "added")]
    assert values(t.read()) == [(1, "a", None), (2, "b", None), (3, None, None), (4, "d", 9)]
    t.write(spark.createDataFrame([(4, "e", 10)], "k bigint, v string, more int"), "merge", ["k"])
    assert values(t.read().filter("k = 4")) == [(4, "e", 10)]


@pytest.mark.parametrize("partition", [None, "p"])
@pytest.mark.parametrize("strategy", ["merge", "delete_insert"])
def test_untouched_files_stay(spark, tmp_path, strategy, partition):
    path = str(tmp_path / "t")
    t = ParquetTable(spark, path)
    rows = spark.range(1000).selectExpr("id k", "concat('p ', id div 250) p", "'old' v").repartitionByRange(8, "k")
    t.write(rows, "append", partition=partition)
    before = files(path)
    change = spark.createDataFrame([(5, "p 0", "new"), (6, "p 0", "new"), (5000, "p 9", "new"), (None, "p 0", "null")], "k bigint, p string, v string")
    got = t.write(change, strategy, ["k"])
    after = files(path)
    kept = {f: at for f, at in before.items() if after.get(f) == at}
    assert len(kept) == len(before) - 1 and got["files_rewritten"] == 1
    assert (got["rows_inserted"], got["rows_updated"], got["rows_deleted"]) == ((2, 2, 0) if strategy == "merge" else (4, 0, 2))
    want = [(k, f"p {k // 250}", "new" if k in (5, 6) else "old") for k in range(1000)] + [(5000, "p 9", "new"), (None, "p 0", "null")]
    assert values(t.read().select("k", "p", "v")) == sorted(want, key=repr)
    assert t.write(change.filter("k is null"), "delete_insert", ["k"])["files_rewritten"] == 0
    moved = t.write(spark.createDataFrame([(7, "p 3", "moved")], "k bigint, p string, v string"), "merge", ["k"])
    assert moved["files_rewritten"] == 1 and values(t.read().filter("k = 7").select("p", "v")) == [("p 3", "moved")] and t.read().count() == 1003


def test_a_journal_is_carried_out(spark, tmp_path, monkeypatch):
    t = ParquetTable(spark, str(tmp_path / "t"))
    t.write(spark.range(100).selectExpr("id k", "0 v").repartitionByRange(4, "k"), "append")
    change = spark.createDataFrame([(3, 1)], "k bigint, v int")
    with monkeypatch.context() as m:
        m.setattr(ParquetTable, "_carry_out", lambda self: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.write(change, "merge", ["k"])
    assert os.path.exists(tmp_path / "t.journal")
    again = ParquetTable(spark, str(tmp_path / "t"))
    assert values(again.read().filter("v = 1")) == [(3, 1)] and again.read().count() == 100
    assert not os.path.exists(tmp_path / "t.journal") and not os.path.exists(tmp_path / "t.add")


def test_keys_of_many_kinds(spark, tmp_path):
    """The least and greatest key go through the driver unchanged."""
    for n, (kind, a, b) in enumerate([("timestamp_ntz", "2024-03-31 02:30:00.000001", "2024-01-01 00:00:00"), ("timestamp", "2024-10-27 02:30:00.5", "2024-01-01 00:00:00"), ("date", "0099-01-01", "2024-01-01"), ("double", "0.1", "1e300"), ("decimal(20,3)", "1.005", "-7"), ("string", "é'\\\\", "")]):
        t = ParquetTable(spark, str(tmp_path / f"t{n}"))
        make = lambda rows, kind=kind: spark.createDataFrame(rows, "k string, v int").select(F.col("k").cast(kind), "v")
        t.write(make([(a, 1), (b, 1)]), "append")
        assert t.write(make([(a, 2)]), "merge", ["k"])["rows_updated"] == 1, kind
        assert sorted(r["v"] for r in t.read().collect()) == [1, 2]


def history(rng, keys, at0=datetime(2024, 1, 1)):
    rows = []
    for k in keys:
        at = at0 + timedelta(hours=rng.randrange(50))
        for n in range(rng.randrange(0, 6)):
            to = at + timedelta(hours=rng.randrange(0, 30))
            rows.append((k, at, None if n == 4 else to, f"{k}-{n}"))
            at = to + timedelta(hours=rng.choice([0, 0, 5]))
            if rows[-1][2] is None:
                break
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_as_of_merge(spark, seed):
    rng = random.Random(seed)
    versions = spark.createDataFrame(history(rng, [*range(12), None]), "key int, valid_from timestamp_ntz, valid_to timestamp_ntz, v string")
    pick = lambda: rng.choice([3] * 8 + [*range(15), None])  # noqa: E731  # key 3 has a third of all facts
    facts = [(pick(), None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(12_000)), n) for n in range(600)]
    facts = spark.createDataFrame(facts, "fk int, at timestamp_ntz, n int")
    want = as_of_validity(facts, versions, [("fk", "key")], "at")
    got = as_of_merge(facts, versions, [("fk", "key")], "at")
    assert got.columns == want.columns and values(got) == values(want) and got.count() > 50
    left = as_of_merge(facts, versions, [("fk", "key")], "at", how="left")
    assert left.count() == 600 and values(left.filter("v is not null")) == values(want)
    assert as_of_merge(facts.limit(0), versions, [("fk", "key")], "at").count() == as_of_merge(facts, versions.limit(0), [("fk", "key")], "at").count() == 0


def test_as_of_merge_spreads_a_hot_key(spark):
    """No join of facts with versions, and no task with all rows of the hot key."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        versions = spark.range(200).selectExpr("1 key", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) valid_from", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int) + 1) valid_to", "id v")
        facts = spark.range(4000).selectExpr("if(id % 3 = 0, cast(id as int), 1) fk", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) at", "id n")
        got = as_of_merge(facts, versions, [("fk", "key")], "at")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "fk" not in "".join(x for x in plan.split("\n") if "Join" in x) and plan.count("LogicalRDD") >= 1
        assert values(got) == values(as_of_validity(facts, versions, [("fk", "key")], "at"))
        parts = got.filter("fk = 1").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_late_rows_go_aside(spark, tmp_path):
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    table, aside = (ParquetTable(spark, str(tmp_path / n)) for n in ("table", "aside"))
    batches = [[(1, at(1)), (2, at(2)), (2, at(2))], [(3, at(10)), (1, at(1))], [(4, at(3)), (5, at(9, 12)), (6, None), (3, at(10)), (7, at(11)), (8, at(9))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with jobs.with_rocksdb(spark):
            stream = jobs.with_lateness(jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "ts", "1 day", "k")
            jobs.run_available(stream, str(tmp_path / "log"), jobs.split_late_into(table, aside))
    assert values(table.read().select("k", "ts")) == [(1, at(1)), (2, at(2)), (3, at(10)), (5, at(9, 12)), (7, at(11)), (8, at(9))]
    assert values(aside.read().select("k", "ts")) == [(4, at(3)), (6, None)]


def test_arrival_batches(spark, tmp_path):
    found, batches = (ParquetTable(spark, str(tmp_path / n)) for n in ("files", "batches"))
    (tmp_path / "in" / "deep").mkdir(parents=True)

    def run():
        jobs.run_available(jobs.arrival_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), jobs.arrivals_into(found, batches))

    for names in (["b.csv", "a.tar.gz"], [], ["deep/c"]):
        for n in names:
            (tmp_path / "in" / n).write_text(n)
        run()
    rows = batches.read().orderBy("batch_").collect()
    assert [(r["file_count"], r["file_name"], r["file_ext"], [os.path.basename(p) for p in r["file_paths"]]) for r in rows] == [(2, "a.tar.gz", "gz", ["a.tar.gz", "b.csv"]), (1, "c", "", ["c"])]
    assert values(found.read().select("file_name", "length")) == [("a.tar.gz", 8), ("b.csv", 5), ("c", 6)]


def test_buckets_join_without_exchange(spark):
    from tidewright.sources import files as layout

    a = layout.write_buckets(spark.range(5000).selectExpr("id % 700 k", "id v"), "bucket_a", ["k"], 4)
    b = layout.write_buckets(spark.range(900).selectExpr("id k2", "id w"), "bucket_b", ["k2"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.join(b, F.col("k") == F.col("k2")).groupBy("k").agg(F.sum("w").alias("w"))
        assert both.count() == 700
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucket_a")
        spark.sql("DROP TABLE bucket_b")


def test_interleaved_files_rule_out(spark, tmp_path):
    """A filter on either column leaves few files, by the statistics in their footers."""
    import pyarrow.parquet as pq

    from tidewright.sources import files as layout

    df = spark.range(20_000).selectExpr("id", "pmod(hash(id), 1000) x", "cast(pmod(hash(id, 1), 977) as double) y", "if(id % 50 = 0, null, date_add(date'2024-01-01', cast(id % 90 as int))) d")
    path = str(tmp_path / "t")
    layout.write_interleaved(df.drop("d"), path, ["x", "y"], 64)
    assert values(spark.read.parquet(path)) == values(df.drop("d"))

    def overlapping(column, low, high):
        n = 0
        for f in files(path):
            group = pq.ParquetFile(f).metadata
            column_at = group.schema.names.index(column)
            n += any(group.row_group(k).column(column_at).statistics.min <= high and group.row_group(k).column(column_at).statistics.max >= low for k in range(group.num_row_groups))
        return n

    total = len(files(path))
    assert total > 40 and overlapping("x", 100, 120) < total / 3 and overlapping("y", 100, 120) < total / 3
    layout.write_interleaved(df, str(tmp_path / "nulls"), ["x", "id"], 4)
    assert spark.read.parquet(str(tmp_path / "nulls")).count() == 20_000
    layout.write_interleaved(df.limit(0), str(tmp_path / "none"), ["x"], 4)


def test_sketches_keep_their_bounds(spark, tmp_path):
    from tidewright.operators import sketches

    df = spark.range(60_000).selectExpr("id % 10 day", "if(id % 100 = 0, null, id % 20011) u", "pow(pmod(hash(id), 100003), 2) v")
    table = ParquetTable(spark, str(tmp_path / "s"))
    options = {"distinct": ["u"], "numbers": ["v"], "lg": 11, "k": 200}
    for days in ("day < 6", "day >= 6", "day = 3"):  # the last comes again
        sketches.refresh(table, df.filter(days), "day", **options)
    assert table.read().count() == 10
    got = sketches.estimated(sketches.merged(table.read(), []), {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    exact = df.agg(F.count_distinct("u").alias("u"), F.count_if(F.col("u").isNull()).alias("n")).first()
    assert (got["rows"], got["u_nulls"]) == (60_000, exact["n"])
    assert abs(got["u_distinct"] / exact["u"] - 1) < 3 * 1.04 / 2**5.5
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        rank = df.filter(F.col("v") <= got[f"v_{name}"]).count() / 60_000
        assert abs(rank - q) < 2.3 / 200 * 1.5, name
    none = sketches.estimated(sketches.sketched(df.filter("id is null" if "id" in df.columns else "day < 0"), [], **options), {"p50": 0.5}).first()
    assert none["rows"] == 0 and none["v_p50"] is None


def test_snapshot_batches_touch_few_files(spark, tmp_path):
    """History of batches, a key's null included, against one snapshot after the other; files without a key that comes stay."""
    from tidewright.operators import snapshots

    table = ParquetTable(spark, str(tmp_path / "h"))
    day = lambda d: datetime(2024, 1, d)
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, at timestamp_ntz")
    first = [(k, "a", day(1)) for k in range(100)] + [(None, "n", day(1))]
    batches = [[(3, "b", day(2)), (None, "m", day(2)), (100, "new", day(2))], [(3, "b", day(2)), (4, "late", day(1))], [(3, "c", day(4)), (100, "old", day(1))]]
    want = snapshots.first_snapshot(make(first), ["k"], day(1))
    table.write(want.repartitionByRange(5, "k"), "append")
    each = jobs.snapshot_into(table, ["k"], "at")
    for n, rows in enumerate(batches):
        before = files(str(tmp_path / "h"))
        each(make(rows), n)
        now = max(r[2] for r in rows)
        want = snapshots.apply_snapshot(want, make(rows), ["k"], now, check=None, updated_at="at", partial=True, order="at")
        after = files(str(tmp_path / "h"))
        assert sum(after.get(f) == at for f, at in before.items()) >= len(before) - 3
        assert values(table.read().select(*want.columns)) == values(want)


def test_exact_where_estimates_differ(spark, tmp_path):
    """More values than a sketch keeps apart."""
    from tidewright.plans import catalog

    spark.range(200_000).selectExpr("'A' l_returnflag", "id % 20011 l_suppkey", "cast(id * 7919 % 200003 as double) l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    prices = sorted(k * 7919 % 200003 for k in range(200_000))
    assert values(catalog.queries()["ag_approximate"](spark, str(tmp_path))) == [("A", 20011, prices[99_999], prices[179_999])]
    spark.range(200_000).selectExpr("cast(date_add(date '2024-01-01', cast(id % 30 as int)) as timestamp_ntz) ts", "if(id % 10 = 0, null, id % 60013) user_id", "'x' event_type", "if(id % 7 = 0, null, cast(id * 7919 % 200003 as double)) value").write.parquet(str(tmp_path / "events.parquet"))
    known = sorted(k * 7919 % 200003 for k in range(200_000) if k % 7)
    got = catalog.queries()["pf_sketched_days"](spark, str(tmp_path)).first().asDict()
    users = len({k % 60013 for k in range(200_000) if k % 10})
    at = lambda q: known[math.ceil(len(known) * q) - 1]
    assert got == {"event_type": "x", "rows": 200_000, "user_id_nulls": 20_000, "user_id_distinct": users, "value_nulls": 200_000 - len(known), "value_low": known[0], "value_high": known[-1], "value_median": at(0.5), "value_p90": at(0.9)}


def test_buckets_grow_with_the_rows(spark):
    from tidewright.sources import files as layout

    assert layout.buckets_for(spark.range(10)) == 8 and layout.buckets_for(spark.range(10), spark.range(20_500_000)) == 21


def test_late_rows_of_many_keys_in_one_call():
    """A group of keys is one call with one state."""
    import pandas as pd

    class State:
        value = None
        exists, get = lambda self: self.value is not None, lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 86_400_000)

    state, rows = jobs.LateRows("ts"), State()
    state.init(type("Handle", (), {"getValueState": lambda self, *_: rows})())
    made = pd.DataFrame({"ts": pd.to_datetime([k % 3 for k in range(9000)], unit="D"), "key_": [str(k // 2) for k in range(9000)], "group_": 0})
    out = pd.concat(list(state.handleInputRows((0,), iter([made[:4000], made[4000:]]), Clock())))
    assert out["late_"].sum() == 3000 and (~out["late_"]).sum() == made[made["ts"] >= "1970-01-02"]["key_"].nunique()
    assert pd.concat(list(state.handleInputRows((0,), iter([made]), Clock())))["late_"].all()
