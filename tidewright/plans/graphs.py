"""Lineage, catalog and run analytics, over tables derived from the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineage, resources, runs
from .registry import Registry, Tables

query = Registry()

#: Each supplier is a pipeline, each part a node, each order a resource that its even lines write and its odd lines read.
_BIND = "SELECT 'p' || l_suppkey AS pipeline_id, 'n' || l_partkey AS node_id, CASE WHEN l_linenumber % 2 = 0 THEN 'sink' ELSE 'source' END AS direction, 'file:///d/' || l_orderkey AS resource_fingerprint FROM lineitem"


def _bindings(spark, sf_dir) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    side = F.when(F.col("l_linenumber") % 2 == 0, "sink").otherwise("source")
    return Tables(spark, sf_dir).lineitem.select(named("p", "l_suppkey").alias("pipeline_id"), named("n", "l_partkey").alias("node_id"), side.alias("direction"), named("file:///d/", "l_orderkey").alias("resource_fingerprint"))


@query(f"""WITH b AS (SELECT DISTINCT * FROM ({_BIND})) SELECT u.pipeline_id AS upstream_pipeline_id, u.node_id AS upstream_node_id, d.pipeline_id AS downstream_pipeline_id, d.node_id AS downstream_node_id, u.resource_fingerprint
           FROM b u JOIN b d USING (resource_fingerprint) WHERE u.direction = 'sink' AND d.direction = 'source' AND NOT (u.pipeline_id = d.pipeline_id AND u.node_id = d.node_id)""")
def gr_static_edges(spark, sf_dir):
    return lineage.static_edges(_bindings(spark, sf_dir))


@query(f"""WITH b AS (SELECT DISTINCT * FROM ({_BIND})), e AS (SELECT DISTINCT u.pipeline_id AS a, u.node_id AS c, d.pipeline_id AS x, d.node_id AS y, resource_fingerprint AS r FROM b u JOIN b d USING (resource_fingerprint)
           WHERE u.direction = 'sink' AND d.direction = 'source' AND NOT (u.pipeline_id = d.pipeline_id AND u.node_id = d.node_id))
           SELECT DISTINCT a AS upstream_pipeline_id, c AS upstream_node_id, x AS downstream_pipeline_id, y AS downstream_node_id FROM e WHERE (a, c, x, y) NOT IN (SELECT (a, c, x, y) FROM e WHERE r IN ('file:///d/1', 'file:///d/2'))""")
def gr_observed_edges(spark, sf_dir):
    b = _bindings(spark, sf_dir)
    known = lineage.static_edges(b.filter(F.col("resource_fingerprint").isin("file:///d/1", "file:///d/2")))
    return lineage.observed_edges(b, known).drop("resource_fingerprint")


# customer -> nation -> region, supplier -> nation, supplier -> part, customer -> order -> part, by whole keys
_EDGES = """SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"""


def _edges(spark, sf_dir, cyclic: bool = False) -> DataFrame:
    """cyclic adds an edge back from each region to the suppliers of its nations."""
    t = Tables(spark, sf_dir)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = lambda d, a, b: d.select(name(*a).alias("src"), name(*b).alias("dst"))
    out = pairs(t.customer, ("c", "c_custkey"), ("n", "c_nationkey")).unionByName(pairs(t.nation, ("n", "n_nationkey"), ("r", "n_regionkey"))).unionByName(pairs(t.supplier, ("s", "s_suppkey"), ("n", "s_nationkey")))
    out = out.unionByName(pairs(t.lineitem, ("s", "l_suppkey"), ("p", "l_partkey"))).unionByName(pairs(t.orders, ("c", "o_custkey"), ("o", "o_orderkey"))).unionByName(pairs(t.lineitem, ("o", "l_orderkey"), ("p", "l_partkey")))
    if cyclic:
        out = out.unionByName(pairs(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")), ("r", "n_regionkey"), ("s", "s_suppkey")))
    return out.distinct()


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT dst FROM e WHERE src = 'c7' UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r")
def gr_all_downstream(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return lineage.reachable(e, e.filter("src = 'c7'").select(F.col("src").alias("node"))).select("node")


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT src FROM e WHERE dst = 'r1' UNION SELECT e.src FROM r JOIN e ON r.node = e.dst) SELECT node FROM r")
def gr_all_upstream(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return lineage.reachable(e, e.filter("dst = 'r1'").select(F.col("dst").alias("node")), True).select("node")


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT dst AS node FROM e WHERE src = 's3'")
def gr_direct_downstream(spark, sf_dir):
    return lineage.direct(_edges(spark, sf_dir), "s3")


@query(f"WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, level + 1 FROM r JOIN e ON r.node = e.src) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node")
def gr_levels(spark, sf_dir):
    return lineage.levels(_edges(spark, sf_dir))


# a supplier's nation leads to its region and from there back, so these three and all below them are in or behind a cycle
_CYCLIC = f"(SELECT * FROM ({_EDGES}) UNION SELECT DISTINCT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH RECURSIVE e AS {_CYCLIC}, k(node) AS (SELECT 's' || s_suppkey FROM supplier UNION SELECT e.dst FROM k JOIN e ON k.node = e.src) SELECT node FROM k""")
def gr_cycles(spark, sf_dir):
    return lineage.in_cycles(_edges(spark, sf_dir, True))


@query(f"""WITH b AS (SELECT DISTINCT * FROM ({_BIND}) WHERE NOT (direction = 'sink' AND right(resource_fingerprint, 1) = '7'))
           SELECT pipeline_id, node_id, resource_fingerprint, 'dangling' AS kind FROM b WHERE direction = 'source' AND resource_fingerprint NOT IN (SELECT resource_fingerprint FROM b WHERE direction = 'sink')
           UNION ALL SELECT pipeline_id, node_id, resource_fingerprint, 'orphaned' FROM b WHERE direction = 'sink' AND resource_fingerprint NOT IN (SELECT resource_fingerprint FROM b WHERE direction = 'source')""")
def gr_dangling_and_orphaned(spark, sf_dir):
    b = _bindings(spark, sf_dir).filter(~((F.col("direction") == "sink") & F.col("resource_fingerprint").endswith("7")))
    out = lineage.dangling_sources(b).withColumn("kind", F.lit("dangling"))
    return out.unionByName(lineage.orphaned_sinks(b).withColumn("kind", F.lit("orphaned")))


_COLS = _BIND.replace("SELECT", "SELECT DISTINCT").replace(" FROM", ", CASE l_returnflag WHEN 'A' THEN 'c1' WHEN 'N' THEN 'c2' ELSE 'c3' END AS \"column\" FROM")


def _columns(spark, sf_dir) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    side = F.when(F.col("l_linenumber") % 2 == 0, "sink").otherwise("source")
    column = F.when(F.col("l_returnflag") == "A", "c1").when(F.col("l_returnflag") == "N", "c2").otherwise("c3")
    return Tables(spark, sf_dir).lineitem.select(named("p", "l_suppkey").alias("pipeline_id"), named("n", "l_partkey").alias("node_id"), side.alias("direction"), named("file:///d/", "l_orderkey").alias("resource_fingerprint"), column.alias("column")).distinct()


@query(f"""WITH c AS ({_COLS}) SELECT u.resource_fingerprint, u."column", u.pipeline_id AS upstream_pipeline_id, u.node_id AS upstream_node_id, d.pipeline_id AS downstream_pipeline_id, d.node_id AS downstream_node_id
           FROM c u JOIN c d USING (resource_fingerprint, "column") WHERE u.direction = 'sink' AND d.direction = 'source' AND (u.pipeline_id <> d.pipeline_id OR u.node_id <> d.node_id)""")
def gr_cross_pipeline_columns(spark, sf_dir):
    return lineage.cross_pipeline_columns(_columns(spark, sf_dir))


@query(f"""WITH c AS ({_COLS}) SELECT resource_fingerprint, "column", CASE WHEN bool_or(direction = 'sink') THEN 'sink_only' ELSE 'source_only' END AS side FROM c GROUP BY 1, 2 HAVING count(DISTINCT direction) = 1""")
def gr_one_sided_columns(spark, sf_dir):
    return lineage.one_sided_columns(_columns(spark, sf_dir))


@query(f"""WITH c AS (SELECT DISTINCT pipeline_id AS node, "column" FROM ({_COLS})), e AS (SELECT DISTINCT 'p' || l_suppkey AS src, 'p' || (l_suppkey + 1) AS dst FROM lineitem)
           SELECT src, dst, u."column" AS upstream_column, d."column" AS downstream_column, 'opaque' AS relationship, 'opaque' AS confidence FROM e JOIN c u ON u.node = src JOIN c d ON d.node = dst""")
def gr_opaque_edges(spark, sf_dir):
    line = Tables(spark, sf_dir).lineitem
    text = lambda k: F.concat(F.lit("p"), (F.col("l_suppkey") + k).cast("string"))
    e = line.select(text(0).alias("src"), text(1).alias("dst")).distinct()
    return lineage.opaque_edges(e, _columns(spark, sf_dir).select(F.col("pipeline_id").alias("node"), "column").distinct())


@query("""SELECT 'n' || n_nationkey AS node, 'file:///n/' || n_name AS resource_fingerprint, c AS "column", 'direct' AS relationship, 'exact' AS confidence FROM nation, (VALUES ('k'), ('v')) t(c)""")
def gr_boundary_edges(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    return lineage.boundary_edges(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("file:///n/"), F.col("n_name")).alias("resource_fingerprint"), F.array(F.lit("k"), F.lit("v")).alias("columns")))


@query("""WITH d AS (SELECT n_name AS node, 'c' AS "column", r_name AS upstream_column FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT n_name AS node, 'c' AS "column", r_name AS upstream_column FROM nation JOIN region ON n_nationkey % 5 = r_regionkey WHERE n_nationkey % 2 = 0)
          SELECT node, "column", upstream_column, CASE WHEN a.node IS NOT NULL THEN 'cast' ELSE 'derived' END AS relationship, CASE WHEN a.node IS NOT NULL THEN 'annotation' ELSE 'exact' END AS confidence,
                 a.node IS NOT NULL AND left(node, 1) > 'M' AS warning FROM d FULL JOIN a USING (node, "column", upstream_column)""".replace("a.node IS NOT NULL", "a.flag").replace("SELECT n_name AS node, 'c' AS \"column\", r_name AS upstream_column FROM nation JOIN region ON n_nationkey % 5", "SELECT n_name AS node, 'c' AS \"column\", r_name AS upstream_column, true AS flag FROM nation JOIN region ON n_nationkey % 5").replace("a.flag AND left(node, 1) > 'M'", "coalesce(a.flag, false) AND left(node, 1) > 'M'"))
def gr_annotated_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edge = lambda on: t.nation.join(t.region, on).select(F.col("n_name").alias("node"), F.lit("c").alias("column"), F.col("r_name").alias("upstream_column"))
    derived = edge(F.col("n_regionkey") == F.col("r_regionkey")).withColumns({"relationship": F.lit("derived"), "confidence": F.lit("exact")})
    notes = edge((F.col("n_nationkey") % 5 == F.col("r_regionkey")) & (F.col("n_nationkey") % 2 == 0)).withColumn("relationship", F.lit("cast"))
    known = t.nation.filter(F.substring("n_name", 1, 1) <= "M").select(F.col("n_name").alias("node"), F.lit("c").alias("column"))
    return lineage.annotated(derived, notes, known)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(node, depth) AS (SELECT 'c7', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.node = e.src WHERE depth < 1), f AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
           SELECT src, dst, (depth + 1)::INTEGER AS depth, EXISTS (SELECT 1 FROM f JOIN e ON f.node = e.src WHERE f.depth = 1) AS truncated FROM f JOIN e ON f.node = e.src WHERE depth < 1""")
def gr_column_trace(spark, sf_dir):
    return lineage.trace(_edges(spark, sf_dir), "c7", depth=1)


@query(f"""SELECT DISTINCT "column" FROM ({_COLS}) WHERE lower("column") LIKE '%c1%'""")
def gr_column_search(spark, sf_dir):
    return lineage.column_search(_columns(spark, sf_dir), "C1")


@query(f"SELECT dst, list(DISTINCT src ORDER BY src) AS inputs FROM ({_EDGES}) GROUP BY dst")
def gr_column_facets(spark, sf_dir):
    return lineage.column_facets(_edges(spark, sf_dir))


@query(f"""SELECT resource_fingerprint, coalesce(list(DISTINCT pipeline_id ORDER BY pipeline_id) FILTER (direction = 'sink'), []) AS producers, coalesce(list(DISTINCT pipeline_id ORDER BY pipeline_id) FILTER (direction = 'source'), []) AS consumers FROM ({_BIND}) GROUP BY 1""")
def ct_discover(spark, sf_dir):
    return resources.discover(_bindings(spark, sf_dir))


@query(f"""WITH f AS (SELECT DISTINCT resource_fingerprint FROM ({_BIND})), n AS (SELECT 'file:///d/' || p_partkey AS resource_fingerprint, p_name AS name FROM part WHERE p_partkey % 2 = 0)
           SELECT resource_fingerprint, coalesce(name, regexp_extract(resource_fingerprint, '([^/]*)$', 1)) AS name FROM f LEFT JOIN n USING (resource_fingerprint)""")
def ct_merge_annotations(spark, sf_dir):
    notes = Tables(spark, sf_dir).part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("file:///d/"), F.col("p_partkey").cast("string")).alias("resource_fingerprint"), F.col("p_name").alias("name"))
    return resources.merge_annotations(resources.discover(_bindings(spark, sf_dir)).select("resource_fingerprint"), notes)


@query("""SELECT coalesce(n_name, c) AS name, n_regionkey::VARCHAR AS type, d AS description, n_name IS NULL AS annotated_only FROM nation FULL JOIN (SELECT c_mktsegment AS c, 'x' AS d FROM customer GROUP BY 1) ON n_name = c""")
def ct_merge_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resources.merge_columns(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("type")), t.customer.select(F.col("c_mktsegment").alias("name"), F.lit("x").alias("description")).distinct())


@query(f"""SELECT 'file:///d/' || p_partkey AS resource_fingerprint FROM part WHERE 'file:///d/' || p_partkey NOT IN (SELECT resource_fingerprint FROM ({_BIND}))""")
def ct_dangling_annotations(spark, sf_dir):
    notes = Tables(spark, sf_dir).part.select(F.concat(F.lit("file:///d/"), F.col("p_partkey").cast("string")).alias("resource_fingerprint"))
    return resources.dangling_annotations(notes, _bindings(spark, sf_dir).distinct())


@query("SELECT 'r' || p_partkey % 150 AS resource_fingerprint, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def ct_duplicate_annotations(spark, sf_dir):
    return resources.duplicate_annotations(Tables(spark, sf_dir).part.select(F.concat(F.lit("r"), (F.col("p_partkey") % 150).cast("string")).alias("resource_fingerprint")))


_INDEX = r"SELECT DISTINCT p_partkey, token FROM (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[\s/:@._-]+'), lambda x: x <> '')) AS token FROM part UNION ALL SELECT p_partkey, lower(p_brand) FROM part)"


def _index(spark, sf_dir) -> DataFrame:
    return resources.token_index(Tables(spark, sf_dir).part, "p_partkey", ["p_name", "p_type"], ("p_brand",))


@query(_INDEX)
def ct_token_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"SELECT p_partkey FROM ({_INDEX}) GROUP BY 1 HAVING bool_or(contains(token, 'brand#1')) AND bool_or(contains(token, '2'))")
def ct_search(spark, sf_dir):
    return resources.search(_index(spark, sf_dir), "p_partkey", ["Brand#1", "2"])


@query("SELECT n_name, n AS tagged FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) WHERE n > 0")
def ct_filter_by_tag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tagged = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.array(F.col("c_mktsegment"), F.lit("all")).alias("tags"))
    return resources.with_tag(tagged, "BUILDING").groupBy("n_name").agg(F.count("*").alias("tagged"))


@query("""WITH t AS (SELECT 't' || p_partkey % 60 AS "table", CASE p_size % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'stage' ELSE 'prod' END AS environment, min(p_name) AS location FROM part GROUP BY 1, 2)
          SELECT "table", arg_min(location, list_position(['dev', 'prod'], environment)) AS location, arg_min(environment, list_position(['dev', 'prod'], environment)) AS environment FROM t WHERE environment IN ('dev', 'prod') GROUP BY 1""")
def ct_environment_fallback(spark, sf_dir):
    env = F.when(F.col("p_size") % 3 == 0, "dev").when(F.col("p_size") % 3 == 1, "stage").otherwise("prod")
    tables = Tables(spark, sf_dir).part.groupBy(F.concat(F.lit("t"), (F.col("p_partkey") % 60).cast("string")).alias("table"), env.alias("environment")).agg(F.min("p_name").alias("location"))
    return resources.resolve_environment(tables, ["dev", "prod"])


_RUNS = """SELECT event_id AS id, 'p' || user_id % 40 AS pipeline, CASE WHEN event_id % 13 = 0 THEN 'pending' WHEN event_type = 'purchase' THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'success' END AS status,
  CASE WHEN event_id % 13 <> 0 THEN event_id * 1000 END AS start_ms, event_id * 1000 + floor(value * 100)::BIGINT AS end_ms, 'e' || event_id AS error, event_id % 3 AS env FROM events"""


def _runs(spark, sf_dir) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(i % 13 == 0, "pending").when(kind == "purchase", "failed").when(kind == "click", "running").otherwise("success")
    return Tables(spark, sf_dir).events.select(i.alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("pipeline"), status.alias("status"), F.when(i % 13 != 0, i * 1000).alias("start_ms"), (i * 1000 + F.floor(F.col("value") * 100)).alias("end_ms"), F.concat(F.lit("e"), i.cast("string")).alias("error"), (i % 3).alias("env"))


@query(f"SELECT id FROM ({_RUNS}) WHERE start_ms >= 500000 OR (start_ms IS NULL AND status IN ('pending', 'running'))")
def rn_window(spark, sf_dir):
    return runs.in_window(_runs(spark, sf_dir), 500_000).select("id")


@query(f"SELECT env, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in runs.STATUSES)} FROM ({_RUNS}) GROUP BY env")
def rn_status_counts(spark, sf_dir):
    return runs.status_counts(_runs(spark, sf_dir), "env")


@query(f"SELECT pipeline, count(*) AS failures, arg_max(error, end_ms * 1000000 + id) AS last_error FROM ({_RUNS}) WHERE status = 'failed' GROUP BY 1 ORDER BY failures DESC, pipeline LIMIT 10")
def rn_top_failing(spark, sf_dir):
    return runs.top_failing(_runs(spark, sf_dir))


@query(f"SELECT pipeline, (sum(end_ms - start_ms) // count(end_ms - start_ms))::BIGINT AS mean_ms, max(end_ms - start_ms) AS max_ms FROM ({_RUNS}) WHERE status = 'success' GROUP BY 1 ORDER BY mean_ms DESC, pipeline LIMIT 10")
def rn_slowest(spark, sf_dir):
    return runs.slowest(_runs(spark, sf_dir))


@query(f"""WITH r AS (SELECT *, max((status = 'success')::INTEGER) OVER (PARTITION BY pipeline ORDER BY start_ms NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS well FROM ({_RUNS}))
           SELECT pipeline, arg_min(id, start_ms) AS run_id, min(start_ms) AS start_ms FROM r WHERE status = 'failed' AND well = 1 GROUP BY 1""")
def rn_first_failures(spark, sf_dir):
    return runs.first_failures(_runs(spark, sf_dir))


@query(f"""WITH r AS ({_RUNS}), n AS (SELECT 'r' || p_partkey AS resource, p_size * 20000 AS max_age_ms, p_size * 10000 AS warn_ms, 'p' || p_partkey % 50 AS pipeline FROM part),
           l AS (SELECT pipeline, max(end_ms) AS last FROM r WHERE status = 'success' GROUP BY 1)
           SELECT resource, last AS last_success_ms, 1100000 - last AS age_ms, CASE WHEN last IS NULL THEN 'unknown' WHEN 1100000 - last > max_age_ms THEN 'breach' WHEN 1100000 - last > warn_ms THEN 'warning' ELSE 'ok' END AS status FROM n LEFT JOIN l USING (pipeline)""")
def rn_sla(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    resource = F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("resource")
    notes = part.select(resource, (F.col("p_size") * 20_000).alias("max_age_ms"), (F.col("p_size") * 10_000).alias("warn_ms"))
    return runs.sla(notes, part.select(resource, F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("pipeline")), _runs(spark, sf_dir), 1_100_000)


@query(f"WITH r AS ({_RUNS}) SELECT pipeline, id FROM r QUALIFY start_ms = max(start_ms) OVER (PARTITION BY pipeline)")
def rn_latest(spark, sf_dir):
    return runs.latest_per(_runs(spark, sf_dir), "pipeline", "start_ms").select("pipeline", "id")


_NODE_RUN = "SELECT 'n' || user_id AS node, sum(floor(value * 100)::BIGINT)::BIGINT AS duration_ms, count(*) AS rows FROM events WHERE event_id % 2 = {k} GROUP BY 1"


@query(f"WITH a AS ({_NODE_RUN.format(k=0)}), b AS ({_NODE_RUN.format(k=1)}) SELECT coalesce(a.node, b.node) AS node, a.duration_ms AS a_ms, b.duration_ms AS b_ms, b.duration_ms - a.duration_ms AS delta_ms, b.rows - a.rows AS delta_rows, CASE WHEN a.node IS NULL THEN 'only_b' WHEN b.node IS NULL THEN 'only_a' ELSE 'both' END AS presence FROM a FULL JOIN b ON a.node = b.node")
def rn_compare(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    one = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node")).agg(F.sum(F.floor(F.col("value") * 100)).alias("duration_ms"), F.count("*").alias("rows"))
    return runs.compare(one(0), one(1))


_TEST = "SELECT 't' || user_id AS test, bool_and(value < 90) AS passed FROM events WHERE event_id % 2 = {k} GROUP BY 1"


@query(f"WITH a AS ({_TEST.format(k=0)}), b AS ({_TEST.format(k=1)}) SELECT coalesce(a.test, b.test) AS test, a.passed AS a_passed, b.passed AS b_passed, a.passed IS DISTINCT FROM b.passed AS changed FROM a FULL JOIN b ON a.test = b.test")
def rn_compare_tests(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    one = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("test")).agg(F.bool_and(F.col("value") < 90).alias("passed"))
    return runs.compare_tests(one(0), one(1))


@query("""SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS row FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 25""")
def rn_failure_sample(spark, sf_dir):
    return runs.failure_sample(Tables(spark, sf_dir).events.filter("event_type = 'purchase'").select("event_id", "user_id"), key="event_id")


@query(f"""WITH c AS ({_COLS}) SELECT DISTINCT pipeline_id, node_id, "column" FROM c WHERE resource_fingerprint = 'file:///d/3' AND "column" IN ('c1', 'c2')""")
def gr_resolve_columns(spark, sf_dir):
    c = _columns(spark, sf_dir)
    wanted = c.filter((F.col("resource_fingerprint") == "file:///d/3") & F.col("column").isin("c1", "c2")).select("resource_fingerprint", "column")
    return lineage.resolve_columns(c, wanted)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT dst FROM e WHERE src = 's5' UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node, left(node, 1) AS pipeline FROM r""")
def gr_column_impact(spark, sf_dir):
    e = _edges(spark, sf_dir)
    owner = e.select(F.col("dst").alias("node"), F.substring("dst", 1, 1).alias("pipeline"))
    return lineage.column_impact(e, "s5", owner, depth=60)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT dst FROM e WHERE left(src, 1) = 's' UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT left(node, 1) AS pipeline, count(DISTINCT node) AS nodes FROM r GROUP BY 1""")
def gr_pipeline_impact(spark, sf_dir):
    e = _edges(spark, sf_dir)
    owner = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("pipeline", F.substring("node", 1, 1))
    return lineage.pipeline_impact(e, owner, "s")


@query(f"SELECT id, pipeline FROM ({_RUNS}) WHERE end_ms >= 700000")
def gr_retained(spark, sf_dir):
    return lineage.retained(_runs(spark, sf_dir), "end_ms", 700_000).select("id", "pipeline")


@query("SELECT c_custkey, c_mktsegment AS owner FROM customer WHERE c_mktsegment = 'BUILDING'")
def ct_filter_by_owner(spark, sf_dir):
    return resources.with_owner(Tables(spark, sf_dir).customer.select("c_custkey", F.col("c_mktsegment").alias("owner")), "BUILDING")


@query("SELECT 'owner' AS kind, c_mktsegment AS name, count(*) AS resources FROM customer GROUP BY 2 UNION ALL SELECT DISTINCT 'tag', n_name, NULL::BIGINT FROM nation JOIN customer ON c_nationkey = n_nationkey")
def ct_owners_and_tags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    owners = resources.all_owners(t.customer.select(F.col("c_mktsegment").alias("owner"))).select(F.lit("owner").alias("kind"), F.col("owner").alias("name"), "resources")
    tags = resources.all_tags(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array("n_name").alias("tags")))
    return owners.unionByName(tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("long").alias("resources")))


@query("""SELECT 'events' AS input, count(*) AS total_rows, 'struct<event_id:bigint,user_id:bigint>' AS schema, (SELECT list(row ORDER BY row) FROM (SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS row FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 5)) AS sample FROM events WHERE event_type = 'purchase'""")
def rn_failure_report(spark, sf_dir):
    failed = Tables(spark, sf_dir).events.filter("event_type = 'purchase'").select("event_id", "user_id")
    return runs.failure_report({"events": failed}, 5, {"events": "event_id"})


@query(f"""WITH e AS ({_EDGES}) SELECT dst AS node, src AS upstream FROM e WHERE left(dst, 1) <> 'r' UNION ALL SELECT 'r' || r_regionkey, 'new' FROM region""")
def gr_replace_edges(spark, sf_dir):
    """All edges into the regions are replaced at once."""
    stored = _edges(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("upstream"))
    fresh = Tables(spark, sf_dir).region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("new").alias("upstream"))
    return lineage.replace_edges(stored, fresh)
