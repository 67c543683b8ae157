"""Lineage graphs held as edge tables. Closures are iterated joins with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

NODE = ("pipeline_id", "node_id")


def static_edges(bindings: DataFrame) -> DataFrame:
    """From each sink to each source of the same resource, but not to itself: upstream_*, downstream_*, resource_fingerprint."""
    side = lambda d, p: bindings.filter(F.col("direction") == d).select("resource_fingerprint", *(F.col(c).alias(f"{p}_{c}") for c in NODE)).distinct()
    both = side("sink", "upstream").join(side("source", "downstream"), "resource_fingerprint")
    same = (F.col("upstream_pipeline_id") == F.col("downstream_pipeline_id")) & (F.col("upstream_node_id") == F.col("downstream_node_id"))
    return both.filter(~same)


def observed_edges(observations: DataFrame, known: DataFrame) -> DataFrame:
    """Edges seen in runs that the static ones lack."""
    ids = [f"{p}_{c}" for p in ("upstream", "downstream") for c in NODE]
    return static_edges(observations).dropDuplicates(ids).join(known.select(*ids).distinct(), ids, "left_anti")


def direct(edges: DataFrame, node, upstream: bool = False) -> DataFrame:
    a, b = ("dst", "src") if upstream else ("src", "dst")
    return edges.filter(F.col(a) == node).select(F.col(b).alias("node")).distinct()


def reachable(edges: DataFrame, start: DataFrame, upstream: bool = False) -> DataFrame:
    """All nodes that can be reached from `start` (a column node) over one edge or more: node, depth (least). A node on a cycle reaches itself.

    edges: src, dst. A round for each level; the frontier alone meets the edges.
    """
    a, b = ("dst", "src") if upstream else ("src", "dst")
    e = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    frontier, seen, depth = start.select("node").distinct(), None, 0
    while True:
        depth += 1
        new = frontier.join(e, "node").select(F.col("next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, "node", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else seen.unionByName(new)
        if depth % 8 == 0:
            seen = cut(seen)
        frontier = new.select("node")


def _core(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that lead to a node with edges of its own, and those that lead to an end. Ends are mostly the greater part, and needn't be carried through rounds."""
    e = cut(edges.select("src", "dst").distinct())
    onward = e.select(F.col("src").alias("dst")).distinct().withColumn("onward_", F.lit(True))
    marked = cut(e.join(onward, "dst", "left"))
    return marked.filter("onward_").select("src", "dst"), marked.filter("onward_ is null").select("src", "dst")


def levels(edges: DataFrame) -> DataFrame:
    """Topological level of each node (0 without an edge into it): node, level. Nodes on a cycle, and below one, have none (null)."""
    e, ends = _core(edges)
    left = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).union(ends.select("src")).distinct())
    out, level = None, 0
    while True:
        into = e.select(F.col("dst").alias("node")).distinct()
        free = cut(left.join(into, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            inner = rest if out is None else out.unionByName(rest)
            break
        out = free if out is None else out.unionByName(free)
        names = free.select("node")
        left = cut(left.join(names, "node", "left_anti"))
        e = cut(e.join(names.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    above = ends.join(inner.withColumnRenamed("node", "src"), "src")
    last = above.groupBy(F.col("dst").alias("node")).agg(F.when(F.count("level") == F.count("*"), F.max("level") + 1).alias("level"))
    return inner.unionByName(last)


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that a cycle keeps from being ordered, those below it included."""
    return levels(edges).filter(F.col("level").isNull()).select("node")


def dangling_sources(bindings: DataFrame) -> DataFrame:
    return _without(bindings, "source", "sink")


def orphaned_sinks(bindings: DataFrame) -> DataFrame:
    return _without(bindings, "sink", "source")


def _without(bindings: DataFrame, mine: str, other: str) -> DataFrame:
    there = bindings.filter(F.col("direction") == other).select("resource_fingerprint").distinct()
    return bindings.filter(F.col("direction") == mine).select(*NODE, "resource_fingerprint").distinct().join(there, "resource_fingerprint", "left_anti")


def opaque_edges(node_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Each output column of a node from each column of its inputs: node_edges (src, dst), columns (node, column)."""
    up = columns.select(F.col("node").alias("src"), F.col("column").alias("upstream_column"))
    down = columns.select(F.col("node").alias("dst"), F.col("column").alias("downstream_column"))
    return node_edges.join(up, "src").join(down, "dst").withColumn("relationship", F.lit("opaque")).withColumn("confidence", F.lit("opaque"))


def boundary_edges(nodes: DataFrame) -> DataFrame:
    """Direct edges of a source or sink: nodes (node, resource_fingerprint, columns array)."""
    return nodes.select("node", "resource_fingerprint", F.explode("columns").alias("column")).withColumns({"relationship": F.lit("direct"), "confidence": F.lit("exact")})


def annotated(derived: DataFrame, notes: DataFrame, known: DataFrame) -> DataFrame:
    """Derived edges with annotated ones put before them: keys node, column, upstream_column; warning where the column isn't known, edge kept."""
    keys = ["node", "column", "upstream_column"]
    n = notes.select(*keys, F.col("relationship").alias("noted"))
    both = derived.join(n, keys, "full").select(*keys, F.coalesce("noted", "relationship").alias("relationship"), F.when(F.col("noted").isNotNull(), "annotation").otherwise(F.col("confidence")).alias("confidence"))
    there = known.select("node", "column").distinct().withColumn("known_", F.lit(True))
    return both.join(there, ["node", "column"], "left").withColumn("warning", F.col("known_").isNull() & (F.col("confidence") == "annotation")).drop("known_")


def cross_pipeline_columns(columns: DataFrame) -> DataFrame:
    """Column edges between pipelines by resource and canonical column: columns (pipeline_id, node_id, direction, resource_fingerprint, column)."""
    side = lambda d, p: columns.filter(F.col("direction") == d).select("resource_fingerprint", "column", *(F.col(c).alias(f"{p}_{c}") for c in NODE)).distinct()
    both = side("sink", "upstream").join(side("source", "downstream"), ["resource_fingerprint", "column"])
    return both.filter((F.col("upstream_pipeline_id") != F.col("downstream_pipeline_id")) | (F.col("upstream_node_id") != F.col("downstream_node_id")))


def one_sided_columns(columns: DataFrame) -> DataFrame:
    """Columns of a shared resource that only its sinks, or only its sources, have."""
    key = ["resource_fingerprint", "column"]
    sides = columns.groupBy(*key).agg(F.bool_or(F.col("direction") == "sink").alias("sink"), F.bool_or(F.col("direction") == "source").alias("source"))
    return sides.filter("sink <> source").select(*key, F.when(F.col("sink"), "sink_only").otherwise("source_only").alias("side"))


def trace(edges: DataFrame, start: str, upstream: bool = False, depth: int = 10, relationships: list[str] | None = None, confidences: list[str] | None = None) -> DataFrame:
    """Edges met breadth-first from a column: src, dst, depth, and truncated if columns beyond the limit are left."""
    if relationships:
        edges = edges.filter(F.col("relationship").isin(relationships))
    if confidences:
        edges = edges.filter(F.col("confidence").isin(confidences))
    a, b = ("dst", "src") if upstream else ("src", "dst")
    e = cut(edges.select("src", "dst").distinct())
    frontier = e.sparkSession.createDataFrame([(start,)], "node string").withColumn("node", F.col("node").cast(e.schema[a].dataType))
    seen, out, cut_off = frontier, None, False
    for d in range(1, depth + 2):
        met = e.join(frontier, F.col(a) == F.col("node")).select("src", "dst")
        if d > depth:
            cut_off = not met.isEmpty()
            break
        met = cut(met.withColumn("depth", F.lit(d)))
        if met.isEmpty():
            break
        out = met if out is None else out.unionByName(met)
        frontier = cut(met.select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
    out = met if out is None else out
    return out.withColumn("truncated", F.lit(cut_off))


def column_search(columns: DataFrame, text: str) -> DataFrame:
    return columns.filter(F.lower("column").contains(text.lower())).select("column").distinct().orderBy("column")


def column_facets(edges: DataFrame) -> DataFrame:
    """Input fields of each output column."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("inputs"))


def retained(rows: DataFrame, at: str, cutoff) -> DataFrame:
    return rows.filter(F.col(at) >= F.lit(cutoff))


def resolve_columns(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Column keys (pipeline_id, node_id, column) of wanted resources and canonical columns (resource_fingerprint, column)."""
    return columns.join(wanted.distinct(), ["resource_fingerprint", "column"]).select("pipeline_id", "node_id", "column").distinct()


def column_impact(edges: DataFrame, start: str, owner: DataFrame, depth: int = 10) -> DataFrame:
    """Columns below one, with their pipelines: owner (node, pipeline)."""
    below = trace(edges, start, depth=depth).select(F.col("dst").alias("node")).distinct()
    return below.join(owner.distinct(), "node", "left").select("node", "pipeline")


def pipeline_impact(edges: DataFrame, owner: DataFrame, pipeline: str) -> DataFrame:
    """Pipelines below one, with the number of their nodes that it reaches: owner (node, pipeline)."""
    below = reachable(edges, owner.filter(F.col("pipeline") == pipeline).select("node"))
    return below.join(owner.distinct(), "node").groupBy("pipeline").agg(F.count("*").alias("nodes"))


def replace_edges(stored: DataFrame, fresh: DataFrame, node: str = "node") -> DataFrame:
    """The stored column edges with all edges of the nodes in `fresh` replaced at once."""
    return stored.join(fresh.select(node).distinct(), node, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))
