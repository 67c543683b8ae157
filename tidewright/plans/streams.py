"""Streams over the event table, run to the end of what is there, and file sources."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from ..operators import assertions as dq
from ..operators.ranks import with_rank
from ..operators.shared import checkpoint_folder
from ..operators.writes import ParquetTable
from ..sources import dbapi, files, rest
from ..streaming import jobs
from .registry import Registry, Tables, money

query = Registry()


def _folder(spark) -> str:
    """A new folder in the place that all executors share."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _local(folder: str) -> str:
    """A folder of the file system as other programs name it."""
    return unquote(urlparse(folder).path) if ":" in folder else folder


def _events(spark, sf_dir):
    schema = Tables(spark, sf_dir).events.schema
    return jobs.file_stream(spark, f"{sf_dir}/events.parquet*", schema)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ss_window_counts(spark, sf_dir):
    """Counts in windows of a day; each batch's changed windows are merged into a table."""
    at = _folder(spark)
    table = ParquetTable(spark, f"{at}/table")
    counts = jobs.window_counts(jobs.event_time(_events(spark, sf_dir), "ts", "40 days"), "ts", "1 day", "event_type")
    jobs.run_available(counts, f"{at}/log", jobs.merge_into(table, ["start", "event_type"]), "update")
    return table.read().withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def ss_incremental_merge(spark, sf_dir):
    at = _folder(spark)
    table = ParquetTable(spark, f"{at}/table")
    jobs.run_available(_events(spark, sf_dir).select("user_id", "event_id", "value"), f"{at}/log", jobs.merge_into(table, ["user_id"], "event_id"))
    return table.read()


@query("SELECT event_id, event_type FROM events")
def ss_deduplicated(spark, sf_dir):
    """Every event is sent twice and kept once."""
    at = _folder(spark)
    table = ParquetTable(spark, f"{at}/table")
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = jobs.deduplicated(twice, "ts", "40 days", "event_id").select("event_id", "event_type")
    jobs.run_available(once, f"{at}/log", jobs.append_into(table))
    return table.read().drop("batch_")


@query("SELECT event_id, value FROM events WHERE value >= 50")
def ss_quarantine(spark, sf_dir):
    at = _folder(spark)
    results, bad = ParquetTable(spark, f"{at}/results"), ParquetTable(spark, f"{at}/bad")
    jobs.run_available(_events(spark, sf_dir).select("event_id", "value"), f"{at}/log", jobs.check_into([dq.expression_true("value < 50")], results, bad))
    return bad.read().drop("batch_")


@query("SELECT user_id, max(ts) AS valid_from, true AS is_current FROM events GROUP BY user_id".replace("max(ts)", "(SELECT max(ts) FROM events)"))
def ss_snapshot(spark, sf_dir):
    at = _folder(spark)
    table = ParquetTable(spark, f"{at}/table")
    changes = _events(spark, sf_dir).select("user_id", "ts", "value")

    def each(batch, number):
        last = batch.groupBy("user_id").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
        jobs.snapshot_into(table, ["user_id"], "ts")(last, number)

    jobs.run_available(changes, f"{at}/log", each)
    return table.read().select("user_id", "valid_from", "is_current")


@query("SELECT 'orders.parquet' AS file_name, 'parquet' AS file_ext WHERE EXISTS (SELECT 1 FROM orders)")
def src_arrivals(spark, sf_dir):
    seen = files.arrivals(spark, f"{sf_dir}/region.parquet*").select("file_path")
    found = files.arrivals(spark, f"{sf_dir}/{{region,orders}}.parquet*", seen)
    return found.select("file_name", "file_ext")


@query("SELECT r_regionkey::INTEGER AS r_regionkey, nullif(r_name, 'ASIA') AS r_name FROM region")
def src_csv_with_nulls(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(Tables(spark, sf_dir).region, path, "|")
    return files.read_csv(spark, path, "|", null_values=("ASIA", "-"), schema=Tables(spark, sf_dir).region.schema)


@query("SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation WHERE n_regionkey < 3")
def src_partitioned_parquet(spark, sf_dir):
    path = _folder(spark)
    Tables(spark, sf_dir).nation.write.partitionBy("n_regionkey").parquet(path)
    return files.read_parquet(spark, path, partition_columns=True).filter("n_regionkey < '3'")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey + 10000000, 'O' FROM orders WHERE o_orderstatus = 'O'".replace("WHERE o_orderstatus <> 'P' UNION", "WHERE o_orderstatus IN ('F', 'P') UNION"))
def snk_partition_overwrite(spark, sf_dir):
    """The files of one partition are replaced, the others stay."""
    table = ParquetTable(spark, f"{_folder(spark)}/orders")
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    table.write(o, "insert_overwrite", partition="o_orderstatus")
    table.write(o.filter("o_orderstatus = 'O'").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000), "insert_overwrite", partition="o_orderstatus")
    return table.read()


@query("""
WITH a AS (SELECT event_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-21' OR event_id % 50 = 0 THEN 3 WHEN ts >= TIMESTAMP '2024-01-11' THEN 2 ELSE 1 END AS arrival FROM events),
w AS (SELECT max(ts) FILTER (arrival < 3) - INTERVAL 5 DAY AS behind FROM a)
SELECT event_id, ts, arrival = 3 AND ts < behind AS late FROM a, w""")
def ss_late_rows(spark, sf_dir):
    """Events arrive in three batches, some long after their time; what comes behind the watermark goes to a table of its own."""
    at = _folder(spark)
    table, aside = ParquetTable(spark, f"{at}/table"), ParquetTable(spark, f"{at}/late")
    e = Tables(spark, sf_dir).events.select("event_id", "ts")
    day = lambda d: F.col("ts") >= F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    arrival = F.when(day(21) | (F.col("event_id") % 50 == 0), 3).when(day(11), 2).otherwise(1)
    for n in (1, 2, 3):
        e.filter(arrival == n).write.mode("append").parquet(f"{at}/in")
        with jobs.with_rocksdb(spark):
            stream = jobs.with_lateness(jobs.file_stream(spark, f"{at}/in", e.schema), "ts", "5 days", "event_id")
            jobs.run_available(stream, f"{at}/log", jobs.split_late_into(table, aside))
    late = lambda t, flag: t.read().select("event_id", "ts", F.lit(flag).alias("late"))
    return late(table, False).unionByName(late(aside, True))


@query("""
SELECT (c_nationkey >= 10)::INTEGER AS batch, count(DISTINCT c_nationkey) AS file_count, min('c_nationkey=' || c_nationkey) AS first_folder,
       string_agg(DISTINCT 'c_nationkey=' || c_nationkey, ',' ORDER BY 'c_nationkey=' || c_nationkey) AS folders FROM customer GROUP BY 1""")
def src_arrival_batches(spark, sf_dir):
    """The files that two landings bring, by batch: their number, their folders and the first one's."""
    at = _folder(spark)
    found, batches = ParquetTable(spark, f"{at}/files"), ParquetTable(spark, f"{at}/batches")
    c = Tables(spark, sf_dir).customer
    for test in ("c_nationkey < 10", "c_nationkey >= 10"):
        c.filter(test).repartition("c_nationkey").write.mode("append").partitionBy("c_nationkey").parquet(f"{at}/in")
        jobs.run_available(jobs.arrival_stream(spark, f"{at}/in"), f"{at}/log", jobs.arrivals_into(found, batches))
    folder = lambda c: F.regexp_extract(c, "([^/]*)/[^/]*$", 1)
    folders = F.array_join(F.array_sort(F.transform("file_paths", folder)), ",")
    return batches.read().select(F.col("batch_").alias("batch"), "file_count", folder(F.col("file_path")).alias("first_folder"), folders.alias("folders"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def src_database_scan(spark, sf_dir):
    """Orders in a database, read back in ranges of keys; the tests on price and status are the database's."""
    at = _local(_folder(spark))
    dbapi.write_database(Tables(spark, sf_dir).orders, at, "orders")
    tests = [("o_totalprice", ">", 150000), ("o_orderstatus", "=", "F")]
    return dbapi.read_database(spark, at, "orders", columns=["o_orderkey", "o_custkey", "o_totalprice"], where=tests, split=("o_orderkey", 4))


@query("SELECT c_nationkey, count(*) AS customers, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS balance FROM customer GROUP BY c_nationkey")
def src_database_query(spark, sf_dir):
    """A query of the database as a table."""
    at = _local(_folder(spark))
    dbapi.write_database(Tables(spark, sf_dir).customer.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")), at, "customer")
    rows = dbapi.read_database(spark, at, query="SELECT c_nationkey, CAST(count(*) AS TEXT) AS customers, CAST(sum(cents) AS TEXT) AS cents FROM customer GROUP BY c_nationkey")
    return rows.select("c_nationkey", F.col("customers").cast("long").alias("customers"), (F.col("cents").cast("decimal(18,2)") / 100).cast("double").alias("balance"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt ' || c_name ELSE c_name END AS c_name, c_nationkey FROM customer
UNION ALL SELECT c_custkey + 10000000, 'debt ' || c_name, c_nationkey FROM customer WHERE c_acctbal < 0""")
def snk_database_merge(spark, sf_dir):
    """An upsert in one transaction: customers in debt are renamed, and come a second time under new keys."""
    at = _local(_folder(spark))
    c = Tables(spark, sf_dir).customer
    dbapi.write_database(c.select("c_custkey", "c_name", "c_nationkey"), at, "customer")
    debt = c.filter("c_acctbal < 0").select("c_custkey", F.concat(F.lit("debt "), "c_name").alias("c_name"), "c_nationkey")
    dbapi.write_database(debt.unionByName(debt.withColumn("c_custkey", F.col("c_custkey") + 10_000_000)), at, "customer", "merge", ["c_custkey"])
    return dbapi.read_database(spark, at, "customer", split=("c_custkey", 4))


@query("""
SELECT s_suppkey, s_name, 0::BIGINT AS version FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, s_name, v FROM supplier, range(1, 3) t(v) WHERE s_acctbal < 0""")
def snk_database_delete_insert(spark, sf_dir):
    """All rows of the keys that come are deleted first, then every row is added, repeats included."""
    at = _local(_folder(spark))
    s = Tables(spark, sf_dir).supplier
    dbapi.write_database(s.select("s_suppkey", "s_name", F.lit(0).cast("long").alias("version")), at, "supplier")
    twice = s.filter("s_acctbal < 0").select("s_suppkey", "s_name", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version"))
    dbapi.write_database(twice, at, "supplier", "delete_insert", ["s_suppkey"])
    return dbapi.read_database(spark, at, "supplier")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def src_rest_offsets(spark, sf_dir):
    """Customers from a server whose pages are longer than asked for, now by little and now by much: each row is read once."""
    at, limit = _local(_folder(spark)), 100
    ranked = with_rank(Tables(spark, sf_dir).customer, "c_custkey", "c_custkey").withColumn("at_", F.col("rank_") - 1)
    cycle = F.col("at_") % 230
    page = F.col("at_") - cycle + F.when(cycle < 100, 0).otherwise(100)  # pages of 100 and 130 rows
    body = F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey")))
    pages = ranked.groupBy(page.cast("long").alias("page"), "count_").agg(body.alias("body")).select("page", "body")

    def land(rows):
        import os

        os.makedirs(at, exist_ok=True)
        for r in rows:
            with open(f"{at}/page-{r['page']}.json", "w") as f:
                f.write(r["body"])

    end = ranked.select(F.col("count_").alias("page"), F.lit("[]").alias("body")).limit(1)
    pages.unionByName(end).foreachPartition(land)
    spark.dataSource.register(rest.RestSource)
    rows = spark.read.format("rest_pages").options(url=f"file://{at}/page-{{offset}}.json", limit=limit).load()
    return rows.select(F.from_json("row", "c_custkey long, c_name string, c_nationkey int").alias("r")).select("r.*")


@query("""
SELECT o_orderkey, lpad((o_orderkey % 12)::VARCHAR, 3, '0') AS region, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status FROM orders""")
def snk_text_partitions(spark, sf_dir):
    """Partitions named 000 to 011 stay text; a merge rewrites only files that hold a key that comes."""
    table = ParquetTable(spark, f"{_folder(spark)}/orders")
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.lpad((F.col("o_orderkey") % 12).cast("string"), 3, "0").alias("region"), F.col("o_orderstatus").alias("status"))
    table.write(o, "append", partition="region")
    table.write(o.filter("status = 'F'").withColumn("status", F.lit("closed")), "merge", ["o_orderkey"], partition="region")
    return table.read()


@query("""
SELECT o_custkey, count(*) AS lines, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def snk_bucketed_join(spark, sf_dir):
    """Orders and their lines in buckets of the order key, sorted: the join needs no exchange."""
    t, name = Tables(spark, sf_dir), f"b_{uuid.uuid4().hex}"
    n = files.buckets_for(t.orders, t.lineitem)
    orders = files.write_buckets(t.orders, f"{name}_o", ["o_orderkey"], n, _folder(spark))
    lines = files.write_buckets(t.lineitem.select("l_orderkey", "l_quantity"), f"{name}_l", ["l_orderkey"], n, _folder(spark))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("lines"), money("l_quantity").alias("quantity"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 14 AND p_retailprice BETWEEN 905 AND 915")
def snk_interleaved_layout(spark, sf_dir):
    """Parts laid out by size and price together, so that files can be ruled out by either."""
    path = f"{_folder(spark)}/part"
    files.write_interleaved(Tables(spark, sf_dir).part, path, ["p_size", "p_retailprice"], 16)
    return spark.read.parquet(path).filter("p_size BETWEEN 10 AND 14 AND p_retailprice BETWEEN 905 AND 915").select("p_partkey", "p_size", "p_retailprice")
