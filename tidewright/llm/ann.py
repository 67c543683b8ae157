"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, table

#: Bound of the vectors that the index is fitted on; bounds of the number of lists.
TRAIN_VECTORS, LEAST_LISTS, MOST_LISTS = 20_000, 16, 4096
#: Parts of a vector, and codes of a part.
PARTS, CODES = 32, 64
#: Share of true neighbours whose lists must be visited, as measured on the sample, and the sample's queries for that.
REACH, REACH_QUERIES = 0.97, 300
#: Queries whose true neighbours in the whole table are found by brute force; share of these whose lists must be visited, and share that the search must find.
CHECKED, VISITED, FOUND = 128, 0.99, 0.97
#: Vectors in one block of a list, and queries that meet it together; candidates of a block, and of a query, for each neighbour wanted (ties beyond).
BLOCK, QUERIES, KEEP, RERANK = 2048, 256, 8, 20


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's method; an empty cluster takes a random point."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        near = closest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        c = np.add.reduceat(np.r_[x[order], np.zeros((1, x.shape[1]))], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x)), axis=0)
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        c /= np.maximum(n, 1)[:, None]
    return c


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ c.T * -2 + (c * c).sum(1)).argmin(1)
    return out


def fit(x: np.ndarray, lists: int, k: int, seed: int = 3) -> dict:
    """Coarse centroids of unit vectors, a codebook for each part of the residuals, and the lists a query visits.

    The visits are the least number that reaches REACH of the `k` true neighbours of REACH_QUERIES sample vectors within
    the sample, whose neighbours lie farther apart than those of the whole table.
    """
    rng = np.random.default_rng(seed)
    coarse = means(x, lists, rng)
    near = closest(x, coarse)
    residual = split(x - coarse[near])
    some = rng.choice(len(x), min(len(x), REACH_QUERIES), replace=False)
    true = np.argsort(-(x[some] @ x.T), 1)[:, 1 : k + 1]
    place = np.argsort(np.argsort((coarse * coarse).sum(1) - 2 * x[some] @ coarse.T, 1), 1)
    reached = np.bincount(place[np.arange(len(some))[:, None], near[true]].reshape(-1), minlength=lists).cumsum()
    probes = 1 + int(np.searchsorted(reached, REACH * max(1, reached[-1])))
    return {"coarse": coarse, "books": np.stack([means(residual[:, p], CODES, rng) for p in range(PARTS)]), "probes": min(probes, lists)}


def split(x: np.ndarray) -> np.ndarray:
    width = -(-x.shape[1] // PARTS)
    return np.pad(x, ((0, 0), (0, width * PARTS - x.shape[1]))).reshape(len(x), PARTS, width)


def unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encoded(df: DataFrame, model) -> DataFrame:
    """Index entries: list, id, code (PARTS bytes)."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(1))
            near = closest(x, m["coarse"])
            parts = split(x - m["coarse"][near])
            code = np.stack([closest(parts[:, p], m["books"][p]) for p in range(PARTS)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in code], pa.binary())], schema=out)

    return df.mapInArrow(run, schema)


def _truth(reps: DataFrame, ids: np.ndarray, units, k: int) -> list:
    """The `k` nearest entries of a few queries (their ids, and their unit vectors broadcast) by brute force: rows query, least (structs s, i). Each task keeps its best."""
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("i", T.LongType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
        for b in batches:
            if not b.num_rows:
                continue
            others = b.column(0).to_numpy(zero_copy_only=False)
            s = -(units.value @ unit(b.column(1)).T)
            s[ids[:, None] == others] = np.inf
            best, at = np.concatenate([best, s], 1), np.concatenate([at, np.broadcast_to(others, s.shape)], 1)
            some = np.argsort(best, 1, kind="stable")[:, :k]
            best, at = np.take_along_axis(best, some, 1), np.take_along_axis(at, some, 1)
        fine = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[fine]), pa.array(best[fine]), pa.array(at[fine])], schema=out)

    return least(reps.select("id", "vector").mapInArrow(run, schema), ["query"], F.struct("s", "i"), k).collect()


def _fitted_visits(asked: DataFrame, reps: DataFrame, entries: DataFrame, blocks: DataFrame, model, k: int) -> tuple[int, int]:
    """The lists to visit and the factor on KEEP and RERANK with which the search finds FOUND of the true neighbours of CHECKED queries in the whole table.

    Both grow until it does; in the end all lists are visited and all entries reranked, which is brute force.
    """
    some = cut(asked.orderBy(F.xxhash64("query"), "query").limit(CHECKED))
    rows = some.select("query", "vector").collect()
    if not rows:
        return model.value["probes"], 1
    ids = np.array([r["query"] for r in rows], np.int64)
    vectors = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    truth = {r["query"]: r["least"] for r in _truth(reps, ids, reps.sparkSession.sparkContext.broadcast(units), k)}
    if not truth:
        return model.value["probes"], 1
    true = reps.sparkSession.createDataFrame([(h["i"],) for hits in truth.values() for h in hits], "id long").distinct()
    lists = {r["id"]: r["list"] for r in entries.join(F.broadcast(true), "id").select("id", "list").collect()}  # CHECKED * k rows at most
    c = model.value["coarse"]
    place = np.argsort(np.argsort((c * c).sum(1) - 2 * units @ c.T, 1, kind="stable"), 1)
    places = np.sort([place[n, lists[h["i"]]] for n, q in enumerate(ids.tolist()) for h in truth.get(q, ())])
    visits, wide, n = max(model.value["probes"], 1 + int(places[int(np.ceil(VISITED * len(places))) - 1])), 1, reps.count()
    while visits < len(c) or RERANK * k * wide < n:
        near = _near(some, reps, blocks, model, k, visits, wide).groupBy("query").agg(F.collect_list("hit.s").alias("s")).collect()
        found = {r["query"]: r["s"] for r in near}
        limit = {q: max(h["s"] for h in hits) + 1e-12 for q, hits in truth.items()}
        hits = sum(min(len(truth[q]), sum(s <= limit[q] for s in found.get(q, ())) - 1) for q in truth)  # the query itself is found too
        if hits >= FOUND * len(places):
            break
        visits, wide = min(2 * visits, len(c)), 2 * wide
    return visits, wide


def _probes(df: DataFrame, model, visits: int) -> DataFrame:
    """The lists that each query visits: list, query, unit vector."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("query", T.LongType()), T.StructField("unit", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value["coarse"]
        k = min(visits, len(c))
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(1))
            near = np.argsort((c * c).sum(1) - 2 * x @ c.T, 1, kind="stable")[:, :k]
            which = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), b.column(0).cast(pa.int64()).take(which), pa.array([v.tobytes() for v in x], pa.binary()).take(which)], schema=out)

    return df.mapInArrow(run, schema)


def _scanned(pairs: DataFrame, model, keep: int) -> DataFrame:
    """Approximate distances of some queries from a block of codes: the least `keep` of each query, and all that equal the last. A query's table of part distances makes a distance PARTS lookups."""
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", T.LongType()), T.StructField("near", T.DoubleType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for at, queries, units, ids, codes in zip(*(b.column(k) for k in range(5))):
                queries, ids = queries.values.to_numpy(), ids.values.to_numpy()
                vectors = np.frombuffer(b"".join(units.as_py()), np.float64).reshape(len(queries), -1)
                code = np.frombuffer(b"".join(codes.as_py()), np.uint8).reshape(-1, PARTS).T.astype(np.int64)
                found = []
                for q, residual in zip(queries.tolist(), split(vectors - m["coarse"][at.as_py()])):
                    distances = ((residual[:, None] - m["books"]) ** 2).sum(2)
                    d = np.zeros(len(ids))
                    for p in range(PARTS):
                        d += distances[p].take(code[p])
                    best = np.arange(len(ids)) if len(ids) <= keep else np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
                    found.append((np.full(len(best), q), ids[best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=out)

    return pairs.mapInArrow(run, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def least(rows: DataFrame, by: list[str], value: Column, most: int) -> DataFrame:
    """The `most` least values of each group, as an array `least`. Two levels, so that no array grows with the group."""
    part = rows.select(*by, value.alias("v_"), F.pmod(F.xxhash64(value), F.lit(32)).alias("part_"))
    for keys in ([*by, "part_"], by):
        part = part.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("v_")) if keys == by else F.collect_list("v_")), 1, most).alias("v_"))
    return part.withColumnRenamed("v_", "least")


def _near(asked: DataFrame, reps: DataFrame, blocks: DataFrame, model, k: int, visits: int, wide: int) -> DataFrame:
    """For each distinct query vector (query: its representative): hit (s: score less than 0, i), its k + 1 nearest entries, itself among them."""
    probes = cut(_probes(asked.select("query", "vector"), model, visits))
    many = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("chunks")))  # a row for each list
    chunks = probes.join(many, "list").groupBy("list", F.pmod(F.xxhash64("query"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("query", "unit")).alias("rows"))
    pairs = chunks.join(blocks, "list").select("list", F.col("rows.query").alias("queries"), F.col("rows.unit").alias("units"), "ids", "codes")
    found = cut(_scanned(pairs, model, KEEP * k * wide))
    far = least(found, ["query"], F.col("near"), RERANK * k * wide).select("query", F.element_at("least", -1).alias("far"))
    best = found.join(far, "query").filter("near <= far").select("query", "id").unionByName(asked.select("query", F.col("query").alias("id"))).distinct()
    both = best.join(asked.select("query", F.col("vector").alias("mine")), "query").join(reps.select("id", "vector"), "id")
    scored = both.select("query", F.struct((-cosine(F.col("mine"), F.col("vector"))).alias("s"), F.col("id").alias("i")).alias("hit"))
    return least(scored, ["query"], F.col("hit"), k + 1).select("query", F.explode("least").alias("hit"))


def _ranked(near: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """For each query: top, its k + 1 nearest rows with their scores, its own copies among them."""
    rows = near.join(copies.select(F.col("rep").alias("at"), "id"), F.col("hit.i") == F.col("at")).select("query", F.struct("hit.s", F.col("id").alias("i")).alias("hit"))
    return least(rows, ["query"], F.col("hit"), k + 1).withColumnRenamed("least", "top")


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies `queries` (a condition on the columns of `df`), its `k` nearest other rows by cosine: query_id, rank, vec_id, score.

    Every usable vector is indexed; null or zero vectors, those with null or non-finite components, and those of another
    length than most have take no part. Ids are integers; a null id takes no part; rows that repeat an id count as one, the
    one of the greatest vector. Scores are exact, on the original vectors; ties go to the smaller id. With fewer rows than
    `k` all are returned; an empty table gives no rows.

    Equal vectors are one entry of the index, with their k + 1 smallest ids, which are put in after reranking; so groups of
    copies of any size cost nothing. Candidates that tie at a cut all stay. Queries that find too few rows in the lists
    that they visit visit all lists.

    How many lists are visited and how many candidates reranked is measured in the table itself: CHECKED of the queries meet
    every vector, and both grow until the search finds FOUND of their true neighbours (_fitted_visits).

    The index is fitted on at most TRAIN_VECTORS vectors (lowest hash of the id). The number of lists grows with the root
    of the number of vectors, up to MOST_LISTS. Lists are stored in blocks of about BLOCK codes, which meet QUERIES queries
    at a time, so a list that holds a third of all vectors is many rows.
    """
    spark = df.sparkSession
    all_ = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    all_ = all_.filter(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.max("vector").alias("vector"), F.max("asked").alias("asked"))
    width = all_.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_ = cut(all_.filter(F.size("vector") == width["w"]).withColumn("key", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b"))))
    place = F.row_number().over(W.partitionBy("key").orderBy("id"))
    copies = all_.withColumn("place", place).filter(F.col("place") <= k + 1)  # cut before the shuffle too
    reps = cut(copies.filter("place = 1").select("id", "key", "vector"))
    copies = cut(copies.select("id", "key").join(reps.select("key", F.col("id").alias("rep")), "key").select("id", "rep"))
    n = reps.count()
    last = reps.select(F.xxhash64("id").alias("h")).orderBy("h").limit(TRAIN_VECTORS).agg(F.max("h")).first()[0]
    sample = reps.filter(F.xxhash64("id") <= last).orderBy("id").limit(TRAIN_VECTORS).select("vector").toPandas()["vector"]
    x = np.stack([np.asarray(v, np.float64) for v in sample])
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, n**0.5 / 2)))
    model = spark.sparkContext.broadcast(fit(x / np.linalg.norm(x, axis=1, keepdims=True), lists, k))
    entries = cut(_encoded(reps.select("id", "vector"), model))
    sizes = F.broadcast(entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))  # MOST_LISTS rows at most
    blocks = entries.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "code")).alias("rows")).select("list", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"))
    who = all_.filter("asked").select(F.col("id").alias("query_id"), "key").join(reps.select("key", F.col("id").alias("query")), "key").select("query_id", "query")
    asked = cut(who.select("query").distinct().join(reps.select(F.col("id").alias("query"), "vector"), "query"))
    visits, wide = _fitted_visits(asked, reps, entries, blocks, model, k)
    top = cut(_ranked(_near(asked, reps, blocks, model, k, visits, wide), copies, k))
    short = cut(asked.join(top.filter(F.size("top") > k).select("query"), "query", "left_anti"))
    if n > 1 and not short.isEmpty():
        again = _ranked(_near(short, reps, blocks, model, k, lists, wide), copies, k)
        top = top.join(short.select("query"), "query", "left_anti").unionByName(again)
    others = F.slice(F.filter("top", lambda h: h["i"] != F.col("query_id")), 1, k)
    out = who.join(top, "query").select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def _op8(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {"op8_nearest_neighbours": _op8}
