"""Rules that the queries don't show: errors, nulls, repeats, idempotence."""

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import parameters
from tidewright.operators import assertions as dq
from tidewright.operators import backfill, incremental, lineage, profile, snapshots, writes
from tidewright.operators.joins import band_join
from tidewright.operators.select import columns_matching, exclude
from tidewright.sources import database, files, rest
from tidewright.streaming import jobs


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_selection_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B int")
    assert exclude(df, "b").columns == ["a"]
    with pytest.raises(ValueError):
        exclude(df, "zz")
    with pytest.raises(ValueError):
        columns_matching(df, "^x")
    assert columns_matching(df, "B").columns == ["B"]


def test_merge_rules(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "m", 1)], "k int, v string, at int")
    with pytest.raises(Exception, match="repeated keys"):
        writes.merge(t, s.drop("at"), ["k"]).collect()
    last = writes.latest_rows(s, ["k"], "at").drop("at")
    assert values(writes.merge(t, last, ["k"])) == [(1, "y"), (2, "b"), (None, "m"), (None, "n")]
    assert values(writes.delete_insert(t, last, ["k"])) == [(1, "y"), (2, "b"), (None, "m"), (None, "n")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=8, unique_by=lambda r: r[0]), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), min_size=1, max_size=8, unique_by=lambda r: r[0]))
def test_replay_changes_nothing(spark, target, source):
    t, s = (spark.createDataFrame(x, "k int, v int") for x in (target, source))
    once = writes.merge(t, s, ["k"])
    assert values(once) == values(writes.merge(once, s, ["k"]))
    h = snapshots.first_snapshot(t, ["k"], datetime(2024, 1, 1))
    once = snapshots.apply_snapshot(h, s, ["k"], datetime(2024, 1, 2), hard_deletes="invalidate")
    again = snapshots.apply_snapshot(once, s, ["k"], datetime(2024, 1, 3), hard_deletes="invalidate")
    assert values(once) == values(again)


def test_parquet_table(spark, tmp_path):
    t = writes.ParquetTable(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert t.write(a, "append")["rows_inserted"] == 2
    got = t.write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "merge", ["k"])
    assert (got["rows_inserted"], got["rows_updated"]) == (1, 1)
    assert values(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    got = t.write(a.filter("k = 1"), "delete_insert", ["k"])
    assert got["rows_deleted"] == 1
    assert t.write(a, "truncate_insert")["rows_deleted"] == 3
    assert values(t.read()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        t.write(a, "merge")
    with pytest.raises(ValueError, match="null partition"):
        t.write(a.withColumn("v", F.lit(None).cast("string")), "insert_overwrite", partition="v")


def test_snapshot_rules(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    h = snapshots.first_snapshot(t, ["k"], datetime(2024, 1, 1))
    same = snapshots.classify(h, t, ["k"])
    assert values(snapshots.diff_counts(same)) == [("unchanged", 2)]
    with pytest.raises(ValueError):
        snapshots.apply_snapshot(h, t, ["k"], datetime(2024, 1, 2), hard_deletes="delete", partial=True)
    with pytest.raises(Exception, match="repeated keys"):
        snapshots.classify(h, t.union(t), ["k"]).collect()


def test_incremental_rules(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1),), (None,), (datetime(2024, 1, 3),)], "at timestamp_ntz")
    assert incremental.incremental_filter(e, "at", None).count() == 3
    assert incremental.incremental_filter(e, "at", datetime(2024, 1, 1)).count() == 1
    assert incremental.incremental_filter(e, "at", datetime(2024, 1, 1), back="PT1S").count() == 2
    assert incremental.max_watermark(e, "at").first()["canonical"] == "2024-01-03T00:00:00.000000000Z"
    assert incremental.lookback("P1DT2H") == timedelta(days=1, hours=2)
    with pytest.raises(ValueError):
        incremental.lookback("1 day")
    with pytest.raises(ValueError):
        incremental.incremental_filter(e, "at", 3, kind="int64")
    diff = incremental.schema_diff(e, e.withColumn("new", F.lit(1)))
    assert not incremental.drift_allowed(diff, "fail")
    assert incremental.drift_allowed(diff, "append_new_columns")
    changed = incremental.schema_diff(e, e.select(F.col("at").cast("string").alias("at")))
    assert not incremental.drift_allowed(changed, "sync_all_columns")
    assert incremental.drift_allowed(changed, "ignore")


def test_assertions_and_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (1, None), (None, "zz")], "k int, v string")
    suite = dq.run_suite(d, [dq.not_null("v"), dq.accepted_values("v", ["a"]), dq.unique("k"), dq.matches_regex("v", "^a"), dq.row_count_equal_to(3)])
    assert {r["name"]: r["violation_count"] for r in suite.collect()} == {"not_null(v)": 1, "accepted_values(v)": 1, "unique(k)": 1, "matches_regex(v)": 1, "row_count_equal_to": 0}


def test_profile_and_samples(spark):
    d = spark.createDataFrame([(1, "é", True), (None, None, None)], "n int, s string, b boolean")
    got = {r["column"]: r for r in profile.profile(d).collect()}
    assert (got["s"]["least_bytes"], got["s"]["distinct"], got["b"]["true_count"], got["n"]["nulls"]) == (2, 1, 1, 1)
    r = spark.range(100)
    assert values(profile.sample_random(r, 10, 3, "id")) == values(profile.sample_random(r.repartition(7), 10, 3, "id"))
    assert profile.sample_random(r, 1000, 3, "id").count() == 100
    counts = {m: profile.sampled(r, m, 7, "id").count() for m in ("first", "random", "full")}
    assert counts == {"first": 7, "random": 7, "full": 100}
    for bad in (("some", "id"), ("random", None)):
        with pytest.raises(ValueError):
            profile.sampled(r, bad[0], key=bad[1])


def test_band_join_is_exact(spark):
    a = spark.range(0, 40).selectExpr("id", "id * 0.7 as x")
    b = spark.range(0, 40).selectExpr("id as other", "id * 0.9 - 5 as y")
    want = a.join(b, F.abs(F.col("x") - F.col("y")) < 1.5).select("id", "other")
    assert values(band_join(a, b, [("x", "y", 1.5)]).select("id", "other")) == values(want)


def test_band_join_deals_crowded_cells(spark, monkeypatch):
    """Many pairs from a few kilobytes: they are more than one task's work, and counted without being made."""
    from tidewright.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 1000)
    a = spark.range(0, 600).selectExpr("id", "cast(id % 3 as int) as g", "id % 50 * 0.1 as x").unionByName(spark.createDataFrame([(900, 1, None), (901, 1, float("nan")), (902, 1, -0.0), (903, 2, 3.3)], "id long, g int, x double"))
    b = spark.range(0, 300).selectExpr("id as other", "cast(id % 4 as int) as h", "id % 40 * 0.1 + 0.3 as y").unionByName(spark.createDataFrame([(900, 1, None), (901, 1, float("inf")), (902, 1, 0.0)], "other long, h int, y double"))
    near = (F.abs(F.col("x") - F.col("y")) < 0.3) & (F.abs(F.col("g") - F.col("h")) < 2)
    want = values(a.join(b, near).select("id", "other"))
    got = band_join(a, b, [("x", "y", 0.3), ("g", "h", 2)])
    assert got.rdd.getNumPartitions() > 20 and values(got.select("id", "other")) == want
    counts = joins.band_counts(a, b, "g", ("g", "h", 2), ("x", "y", 0.3))
    assert values(counts) == values(a.join(b, near).groupBy("g").agg(F.count("*")))


def test_levels_carry_no_ends_through_rounds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "z"), ("a", "y"), ("c", "d"), ("d", "c"), ("d", "x"), ("a", "x"), ("w", "v")], "src string, dst string")
    assert values(lineage.levels(e).na.fill(-1)) == [("a", 0), ("b", 1), ("c", -1), ("d", -1), ("v", 1), ("w", 0), ("x", -1), ("y", 1), ("z", 2)]
    assert sorted(map(tuple, lineage._core(e)[0].collect())) == [("a", "b"), ("c", "d"), ("d", "c")]


def test_lineage_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert values(lineage.reachable(e, start).select("node")) == [("a",), ("b",), ("c",)]
    assert values(lineage.in_cycles(e)) == [("a",), ("b",), ("c",)]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(14)], "src string, dst string")
    got = lineage.trace(chain, "0")
    assert got.count() == 10 and got.first()["truncated"]


def test_parameters(spark):
    parameters.sql_function(spark, "plus", {"a": "INT", "b": "INT"}, "INT", "a + b")
    assert spark.sql("SELECT PLUS(1, 2)").first()[0] == 3
    with pytest.raises(ValueError):
        parameters.sql_function(spark, "bad name", {}, "INT", "1")
    with pytest.raises(Exception):
        parameters.run_sql(spark, "SELECT :missing", {}).collect()
    assert parameters.resolve({"a": 1}, {"a": 2}, {"run_id": "r"}) == {"run_id": "r", "a": 2}


def test_csv_json_and_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;NA\n2;'x;y'\n")
    got = files.read_csv(spark, str(tmp_path / "*.csv"), ";", quote="'", null_values=("NA",))
    assert values(got) == [("1", None), ("2", "x;y")]
    (tmp_path / "b.json").write_text('{"data": {"items": [{"k": 1}, {"k": 2}]}}')
    assert values(files.read_json(spark, str(tmp_path / "b.json"), "data.items")) == [(1,), (2,)]
    assert rest.rows_at('{"a": [{"b": 1}]}', "/a") == [{"b": 1}]
    for page in range(3):
        (tmp_path / f"page-{page * 2}.json").write_text(str([{"k": page * 2 + k} for k in range(2 if page < 2 else 1)]).replace("'", '"'))
    spark.dataSource.register(rest.RestSource)
    pages = spark.read.format("rest_pages").options(url=f"file://{tmp_path}/page-{{offset}}.json", limit=2, max_pages=3).load()
    assert pages.count() == 5


def test_database_rules(spark):
    with pytest.raises(ValueError):
        database.read_table(spark, "jdbc:x", table="t", query="q")
    with pytest.raises(ValueError, match="can't hold"):
        database.write_table(spark.createDataFrame([([1],)], "a array<int>"), "jdbc:x", "t")


def test_rest_reads_all_pages(spark, tmp_path):
    for k in range(0, 6, 2):
        (tmp_path / f"all-{k}.json").write_text(json.dumps([k, k + 1][: 1 if k == 4 else 2]))
        (tmp_path / f"next-{k}.json").write_text(json.dumps({"rows": [k], "next": f"file://{tmp_path}/next-{k + 2}.json" if k < 4 else None}))
    spark.dataSource.register(rest.RestSource)
    read = lambda **o: sorted(int(r["row"]) for r in spark.read.format("rest_pages").options(**o).load().collect())
    offset = {"url": f"file://{tmp_path}/all-{{offset}}.json", "limit": 2}
    cursor = {"url": f"file://{tmp_path}/next-0.json", "data_path": "rows", "next_path": "next"}
    assert read(**offset) == [0, 1, 2, 3, 4] and read(**cursor) == [0, 2, 4]
    assert read(**offset, max_pages=3) == [0, 1, 2, 3, 4] and read(**cursor, max_pages=3) == [0, 2, 4]
    for o in (offset, cursor):
        with pytest.raises(Exception, match="max_pages"):
            read(**o, max_pages=2)


def test_partitioned_table_keeps_rows(spark, tmp_path):
    t = writes.ParquetTable(spark, str(tmp_path / "p"))
    a, b = (spark.createDataFrame([(k, v, "x")], "k int, v string, p string") for k, v in ((1, "a"), (2, "b")))
    t.write(a, "append", partition="p")
    t.write(b, "append", partition="p")
    assert values(t.read()) == [(1, "a", "x"), (2, "b", "x")]
    got = t.write(a.withColumn("v", F.lit("c")), "merge", ["k"], partition="p", watermark="k")
    assert values(t.read()) == [(1, "c", "x"), (2, "b", "x")]
    assert (got["rows_scanned"], got["rows_updated"], got["rows_inserted"], got["watermark_before"], got["watermark_after"]) == (1, 1, 0, "2", "1")
    t.write(b.withColumn("v", F.lit("d")), "insert_overwrite", partition="p")
    assert values(t.read()) == [(2, "d", "x")]
    (tmp_path / "p").rename(tmp_path / "p.old")  # a crash between the two renames
    assert values(t.read()) == [(2, "d", "x")] and not (tmp_path / "p.old").exists()


def test_scd_ids_differ(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "b|c"), ("a|b", "c")], "x string, y string")
    ids = {r["scd_id"] for at in (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1)) for r in snapshots.first_snapshot(df, ["x", "y"], at).collect()}
    assert len(ids) == 8


def test_replayed_batch_adds_nothing(spark, tmp_path):
    results, bad = (writes.ParquetTable(spark, str(tmp_path / n)) for n in ("results", "bad"))
    each = jobs.check_into([dq.expression_true("k > 1")], results, bad)
    for _ in range(2):
        each(spark.createDataFrame([(1,), (2,)], "k int"), 0)
    assert (results.read().count(), bad.read().count()) == (1, 1)


def test_drift_and_placeholder_errors(spark):
    e = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="policy"):
        incremental.drift_actions(incremental.schema_diff(e, e), "other")
    with pytest.raises(ValueError, match="placeholder"):
        backfill.placeholders("a > $iteration.none", e)
    assert backfill.placeholders("b > $iteration.a", e) == "b > `a`"
    assert incremental.drift_action(incremental.schema_diff(e, e.withColumn("b", F.lit(1))), "sync_all_columns") == "alter"


def test_rest_link_header_and_bodies(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path[-1])
            self.send_response(200)
            if page < 2:
                self.send_header("Link", f'</x{page}>; rel="prev", </rows{page + 1}>; rel="next"')
            self.end_headers()
            self.wfile.write((f'{{"k": {page}}}\n{{"k": {page + 10}}}\n' if self.path.startswith("/rows") else "k,v\n1,\n2,b\n").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.RestSource)
    at = f"http://127.0.0.1:{server.server_port}"
    read = lambda **o: sorted(r["row"] for r in spark.read.format("rest_pages").options(**o).load().collect())
    assert read(url=f"{at}/rows0", body="ndjson", next_path="link") == sorted(json.dumps({"k": k}) for k in (0, 1, 2, 10, 11, 12))
    assert read(url=f"{at}/csv0", body="csv") == ['{"k": "1", "v": null}', '{"k": "2", "v": "b"}']
    server.shutdown()
