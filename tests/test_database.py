"""Scans and transactional writes of a database, on a local file."""

import sqlite3
import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.sources import database, dbapi, files


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "data.db")


def ask(place, sql):
    c = sqlite3.connect(place)
    try:
        return c.execute(sql).fetchall()
    finally:
        c.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_types_round_trip(spark, place):
    row = (True, 7, 2**40, 0.5, "é%_", b"\x00x", date(2024, 2, 29), datetime(2024, 1, 1, 2, 3, 4, 5), Decimal("1.25"))
    df = spark.createDataFrame([row, (None,) * 9], "b boolean, i int, l bigint, d double, s string, x binary, day date, at timestamp_ntz, n decimal(10,2)")
    assert dbapi.write_database(df, place, "t")["rows_inserted"] == 2
    got = dbapi.read_database(spark, place, "t")
    assert [f.dataType.simpleString() for f in got.schema] == ["boolean", "int", "bigint", "double", "string", "binary", "date", "timestamp_ntz", "double"]
    assert values(got) == sorted([(*row[:-1], 1.25), (None,) * 9], key=repr)
    ask(place, "SELECT 1")
    c = sqlite3.connect(place)
    c.execute("CREATE TABLE odd (u UUID, j JSON, m NUMERIC(30, 2), z WHATEVER)")
    c.execute("INSERT INTO odd VALUES ('a-b', '{}', 1.5, 3)")
    c.commit()
    assert values(dbapi.read_database(spark, place, "odd")) == [("a-b", "{}", 1.5, "3")]


TESTS = [
    [("k", "=", 3)], [("k", "<>", 3)], [("k", "in", [1, 2])], [("k", "not in", [1, 2])], [("d", ">", 20.5)], [("d", "is null", None)], [("d", "is not null", None), ("k", ">=", 8)],
    [("s", "=", "n1")], [("s", "starts", "n%_"), ("s", "ends", "2")], [("s", ">", "n0")], [("s", "contains", "%")], [("id", ">=", 5), ("id", "<=", 9), ("k", "<", 7)], [("day", "<", date(2024, 1, 3))], [("k", "in", [])], [("k", "=", None)],
]


def test_tests_reach_the_database(spark, place):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 as int) k", "concat(if(id % 5 = 0, 'n%_', 'n'), id % 3) s", "if(id % 4 = 0, null, id / 8) d", "date_add(date'2024-01-01', cast(id % 7 as int)) day")
    dbapi.write_database(df, place, "t", indexes=[["k"]])
    assert ask(place, "SELECT name FROM sqlite_master WHERE type = 'index' AND name LIKE 't%'") == [("t_k_index",)]
    t = dbapi.read_database(spark, place, "t", split=("id", 4))
    assert t.rdd.getNumPartitions() == 4 and t.count() == 1000 and t.distinct().count() == 1000
    for tests in TESTS:
        want = df
        for test in tests:
            want = want.filter(dbapi.passes(test))
        assert values(dbapi.read_database(spark, place, "t", where=tests, split=("id", 3))) == values(want), tests
    # one scan's tests don't reach another
    two = [dbapi.read_database(spark, place, "t", where=[("k", "=", k)]) for k in (1, 2)]
    assert two[0].union(two[1]).count() == 200 and t.filter("k = 1").union(t.filter("k = 2")).count() == 200 and t.count() == 1000
    # the source itself sends no other rows
    reader = dbapi.DatabaseReader(dbapi.Database("sqlite3", place), {"table": "t", "where": '[["k", "=", 3], ["s", ">", "n0"]]'}, t.schema)
    assert reader.tests == ['"k" = ?']
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 100
    narrow = dbapi.read_database(spark, place, "t", columns=["s"], where=[("k", "=", 1)], limit=7)
    assert narrow.columns == ["s"] and narrow.count() == 7
    grouped = dbapi.read_database(spark, place, query="SELECT k, count(*) AS n FROM t GROUP BY k", where=[("k", "<", 2)], columns=["k"])
    assert values(grouped) == [(0,), (1,)]
    for bad in ({"query": "SELECT 1"}, {"where": [("s", ">", "a")], "limit": 3}, {"where": [("k", "like", 1)]}):
        with pytest.raises((ValueError, KeyError)):
            dbapi.read_database(spark, place, "t", **bad)


def test_write_strategies(spark, place):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert dbapi.write_database(make([(1, "a"), (2, "b"), (None, "n")]), place, "t") == {"strategy": "append", "rows_inserted": 3, "rows_updated": 0, "rows_deleted": 0}
    got = dbapi.write_database(make([(2, "c"), (3, "d"), (None, "m")]), place, "t", "merge", ["k"])
    assert got == {"strategy": "merge", "rows_inserted": 2, "rows_updated": 1, "rows_deleted": 0}
    assert values(dbapi.read_database(spark, place, "t")) == [(1, "a"), (2, "c"), (3, "d"), (None, "m"), (None, "n")]
    assert dbapi.write_database(make([(2, "x"), (2, "y"), (None, "o")]), place, "t", "delete_insert", ["k"])["rows_deleted"] == 1
    assert values(dbapi.read_database(spark, place, "t").filter("k = 2")) == [(2, "x"), (2, "y")]
    with pytest.raises(Exception, match="repeated keys"):
        dbapi.write_database(make([(1, "x"), (1, "y")]), place, "t", "merge", ["k"])
    last = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, at int")
    with pytest.raises(Exception, match="no columns"):
        dbapi.write_database(last, place, "t", "merge", ["k"], "at")
    dbapi.write_database(last, place, "t", "merge", ["k"], "at", add_columns=True)
    assert values(dbapi.read_database(spark, place, "t").filter("k = 1")) == [(1, "y", 2)]
    assert dbapi.write_database(make([(9, "z")]).select("k"), place, "only", "merge", ["k"])["rows_inserted"] == 1
    assert dbapi.write_database(make([(9, "z"), (8, "z")]).select("k"), place, "only", "merge", ["k"]) == {"strategy": "merge", "rows_inserted": 1, "rows_updated": 0, "rows_deleted": 0}
    assert dbapi.write_database(make([(7, "q")]), place, "t", "truncate_insert")["rows_deleted"] == 7
    assert dbapi.write_database(make([]), place, "t")["rows_inserted"] == 0
    assert [t for (t,) in ask(place, "SELECT name FROM sqlite_master WHERE name LIKE 'stage%'")] == []


def test_refused(spark, place):
    with pytest.raises(ValueError, match="can't hold"):
        dbapi.write_database(spark.createDataFrame([([1],)], "a array<int>"), place, "t")
    with pytest.raises(ValueError, match="needs keys"):
        dbapi.write_database(spark.range(1), place, "t", "merge")
    with pytest.raises(ValueError, match="strategy"):
        dbapi.write_database(spark.range(1), place, "t", "upsert")


def test_a_failed_job_changes_nothing(spark, place):
    dbapi.write_database(spark.range(10), place, "t")
    broken = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    for strategy in ("append", "truncate_insert"):
        with pytest.raises(Exception, match="lost"):
            dbapi.write_database(broken, place, "t", strategy)
        assert ask(place, "SELECT count(*), max(id) FROM t") == [(10, 9)]
    assert ask(place, "SELECT count(*) FROM sqlite_master WHERE name LIKE 'stage%'") == [(0,)]


def test_only_attempts_that_count(spark, place):
    """A lost attempt's rows stay out, and a commit that comes again adds nothing."""
    import pyarrow as pa

    schema = T.StructType.fromDDL("k int")
    options = {"table": "t", "job": "j1"}
    writer = dbapi.DatabaseWriter(dbapi.Database("sqlite3", place), options, schema, False)
    batch = lambda *k: iter([pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32())})])
    lost, kept, other = writer.write(batch(1, 2)), writer.write(batch(1, 2, 3)), writer.write(batch(4))
    assert lost.rows == 2
    writer.commit([kept, other])
    writer.commit([kept, other])
    assert sorted(ask(place, "SELECT k FROM t")) == [(1,), (2,), (3,), (4,)]


def test_jdbc_pushes_filters_and_columns(spark):
    """Spark's own database source, on the database that it brings along."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).selectExpr("id", "cast(id % 10 as int) k", "concat('n', id % 3) s", "cast(id / 8 as decimal(12, 3)) d")
    database.write_table(df, url, "t", mode="overwrite", createTableColumnTypes="s VARCHAR(20)", **driver)
    database.write_table(df.limit(0), url, "t", **driver)
    t = database.read_table(spark, url, "t", split=("ID", 0, 1000, 4), **driver)
    assert t.rdd.getNumPartitions() == 4 and values(t.toDF("id", "k", "s", "d")) == values(df)
    some = t.filter("k = 3 and s = 'n1'").select("id")
    scan = next(x for x in plan(some).split("\n") if "Scan JDBC" in x)
    assert "EqualTo(k,3)" in scan and "EqualTo(s,n1)" in scan and "[id" in scan and "ReadSchema: struct<id:bigint>" in scan
    assert values(some) == values(df.filter("k = 3 and s = 'n1'").select("id"))
    kinds = lambda x: {f.name.lower(): f.dataType.simpleString() for f in x.schema}
    assert kinds(t)["d"] == "decimal(12,3)"
    assert kinds(database.read_table(spark, url, "t", doubles=True, schema="k BIGINT", **driver)) | {"s": ""} == {"id": "bigint", "k": "bigint", "s": "", "d": "double"}
    grouped = database.read_table(spark, url, query='SELECT "k", count(*) AS n FROM t GROUP BY "k"', **driver)
    assert values(grouped.filter("k < 2")) == [(0, 100), (1, 100)]


def test_storage_options(spark, tmp_path):
    at, options = files.located("s3://b/x", {"aws_access_key_id": "a", "aws_secret_access_key": "b", "aws_session_token": "c", "aws_endpoint": "http://h:9", "aws_allow_http": "true"})
    assert at == "s3a://b/x" and options["fs.s3a.access.key"] == "a" and options["fs.s3a.endpoint"] == "http://h:9" and options["fs.s3a.connection.ssl.enabled"] == "false"
    assert options["fs.s3a.aws.credentials.provider"].endswith("TemporaryAWSCredentialsProvider")
    assert files.located("s3a://b/x", {"aws_skip_signature": "true"})[1]["fs.s3a.aws.credentials.provider"].endswith("AnonymousAWSCredentialsProvider")
    azure = files.located("az://box/d/x", {"azure_storage_account_name": "acc", "azure_storage_account_key": "k"})
    assert azure == ("abfss://box@acc.dfs.core.windows.net/d/x", {"fs.azure.account.key.acc.dfs.core.windows.net": "k"})
    assert files.located("gs://b/x") == ("gs://b/x", {}) and files.located("/tmp/x") == ("/tmp/x", {})
    for bad in (("az://box/x", {}), ("s3://b/x", {"aws_key": "a"})):
        with pytest.raises(ValueError):
            files.located(*bad)
    # options reach the file system of this read alone
    spark.range(5).write.parquet(str(tmp_path / "in"))
    mount = {"fs.viewfs.mounttable.elsewhere.link./data": f"file://{tmp_path}"}
    assert files.read_parquet(spark, "viewfs://elsewhere/data/in", storage=mount).count() == 5
    spark.range(3).selectExpr("id k").write.csv(str(tmp_path / "csv"), header=True)
    assert files.read_csv(spark, "viewfs://elsewhere/data/csv", storage=mount).count() == 3


def test_another_driver(tmp_path):
    """The same statements on a database with other types; its file takes one process, so tasks are called here."""
    import json

    import pyarrow as pa

    pytest.importorskip("duckdb")
    base = dbapi.Database("duckdb", str(tmp_path / "d.duckdb"))
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("day", T.DateType())])
    day = date(2024, 1, 2)

    def write(strategy, job, *rows):
        w = dbapi.DatabaseWriter(base, {"table": "t", "strategy": strategy, "keys": "k", "job": job}, schema, False)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.date32()))]
        w.commit([w.write(iter([pa.RecordBatch.from_arrays(columns, names=schema.names)]))])

    write("append", "j1", (1, "a", day), (2, "b", None))
    write("merge", "j2", (2, "c", day), (3, "d", day))
    write("delete_insert", "j3", (1, "z", day), (1, "y", day))
    with base.cursor() as c:
        assert c.execute('SELECT * FROM "t" ORDER BY k, v').fetchall() == [(1, "y", day), (1, "z", day), (2, "c", day), (3, "d", day)]
        assert c.execute("SELECT * FROM write_receipts ORDER BY job").fetchall() == [("j1", "append", 2, 0, 0), ("j2", "merge", 1, 1, 0), ("j3", "delete_insert", 2, 0, 1)]
        assert base.columns_of_query(c, "SELECT k, count(*) AS n FROM t GROUP BY k") == {"k": "integer", "n": "bigint"}
    reader = dbapi.DatabaseReader(base, {"table": "t", "where": json.dumps([["day", "=", "2024-01-02"], ["v", "starts", "z"]]), "partition_column": "k", "partitions": "2"}, schema)
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[{"k": 1, "v": "z", "day": day}]]


def test_csv_is_added_to(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame([(1, "a;b")], "k int, v string"), path, ";")
    files.write_csv(spark.createDataFrame([(2, None)], "k int, v string"), path, ";", mode="append")
    assert values(files.read_csv(spark, path, ";")) == [(1, "a;b"), (2, None)]
    with pytest.raises(ValueError):
        files.write_csv(spark.range(1), path, mode="merge")


def test_large_merges_and_few_transactions(spark, place, monkeypatch):
    """A merge finds its rows by key, and a task stages many rows at once."""
    import time

    begun = time.monotonic()
    dbapi.write_database(spark.range(60_000).selectExpr("id k", "'a' v"), place, "t")
    assert dbapi.write_database(spark.range(30_000, 90_000).selectExpr("id k", "'b' v"), place, "t", "merge", ["k"]) == {"strategy": "merge", "rows_inserted": 30_000, "rows_updated": 30_000, "rows_deleted": 0}
    assert dbapi.write_database(spark.range(60_000).selectExpr("id k", "'c' v"), place, "t", "delete_insert", ["k"])["rows_deleted"] == 60_000
    assert ask(place, "SELECT v, count(*) FROM t GROUP BY v ORDER BY v") == [("b", 30_000), ("c", 60_000)] and time.monotonic() - begun < 60
    import pyarrow as pa

    base, schema, n = dbapi.Database("sqlite3", place), T.StructType.fromDDL("k bigint"), []
    writer = dbapi.DatabaseWriter(base, {"table": "u", "job": "j"}, schema, False)
    real = base.transaction
    monkeypatch.setattr(base, "transaction", lambda: (n.append(1), real())[1])
    assert writer.write(iter([pa.RecordBatch.from_pydict({"k": pa.array(range(10_000))})] * 3)).rows == 30_000 and len(n) == 1
    writer.abort([])
