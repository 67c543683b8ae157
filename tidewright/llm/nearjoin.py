"""MinHash near-dedup: a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, fitted, kept, table
from .graph import components

#: Words of a shingle, and the similarity from which documents are linked (a fraction of 100).
SHINGLE, PERCENT = 5, 85
#: Minwise hashes of a set; the first TREES of them are the roots of the trees.
HASHES, TREES = 64, 12
#: Sets in a node that are compared in one task; sets beyond which a node branches; levels of branching below a root.
LEAF, LARGE, LEVELS = 800, 4096, 24
#: Sets beyond which a node is crowded, so that leaders join its near-copies first (smaller ones are compared in one task anyway); rounds of leaders.
CROWD, ROUNDS = LEAF, 2
#: A pair goes to the exact comparison unless its minwise estimate is so far below the similarity (3.6 deviations).
SLACK = 3.6 * (PERCENT / 100 * (1 - PERCENT / 100) / HASHES) ** 0.5
#: Most representatives whose ids are broadcast to fetch their texts; beyond it the join is shuffled.
FETCH_ROWS = 500_000
#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000

find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    """64-bit hash of each word; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; with fewer words, of the whole sequence; none without words."""
    words = find_words(text.translate(lower))
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(kept("shingles").setdefault("words", _Hashes()).__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(a))
    out = np.full(len(a) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ a[j : len(a) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def minwise(s: np.ndarray) -> bytes:
    a, b = _factors()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(out, (s[k : k + 4096, None] * a + b).min(0), out=out)
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def features(df: DataFrame, id_col: str, text_col: str, sets: bool) -> DataFrame:
    """id, n (size of the shingle set), key (128-bit hash of the set), sig (minwise hashes), and the set itself if asked for."""
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("shingles", T.BinaryType())] * sets)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                s = shingle_set(x.as_py() or "")
                raw = s.astype("<u8").tobytes()
                rows.append((len(s), xxhash.xxh3_128_digest(raw), minwise(s), raw)[: 3 + sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * (3 + sets), list(out)[1:]))], schema=out)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def coordinate(sig: Column, k: Column) -> Column:
    return F.substring(sig, k * 4 + 1, F.lit(4))


def branch(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """Children of large nodes: each takes one minwise token of its sets, chosen by the node, and in 100 / PERCENT - 1 of the cases a second.

    So a pair of the wanted similarity stays together in one child on average.
    """
    chosen = lambda salt: (F.lit(TREES) + F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(HASHES - TREES))).cast("int")
    twice = F.pmod(F.xxhash64("path", F.lit("twice")), F.lit(10_000)) < int(10_000 * (100 / PERCENT - 1))
    at = nodes.select("path", "key", F.explode(F.when(twice, F.array(chosen("a"), chosen("b"))).otherwise(F.array(chosen("a")))).alias("at"))
    return at.join(reps.select("key", "sig"), "key").select(F.xxhash64("path", "at", coordinate(F.col("sig"), F.col("at"))).alias("path"), "key")


def sized(nodes: DataFrame) -> DataFrame:
    """The rows of nodes with two sets or more, and the number of sets."""
    return fitted(nodes.join(nodes.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "path"))


def roots(reps: DataFrame) -> DataFrame:
    tokens = F.posexplode(F.array(*(F.xxhash64(F.lit(k), coordinate(F.col("sig"), F.lit(k))) for k in range(TREES))))
    return sized(reps.select(tokens.alias("tree", "path"), "key"))


def with_group(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds the group of each set: itself, unless leaders have joined it with others."""
    if groups is None:
        return rows.withColumn("group", F.col("key"))
    return rows.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))


def bulks(rows: DataFrame) -> DataFrame:
    """The largest group of each node (path, group) and its number of sets."""
    return rows.groupBy("path", "group").agg(F.count("*").alias("bulk")).groupBy("path").agg(F.max(F.struct("bulk", "group")).alias("most"))


def led(crowded: DataFrame, reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """Links between sets of crowded nodes (path, key) and a leader of their node, and the groups (key, group) that they make.

    In each round a node takes as its leader one set outside its largest group, and only the sets outside meet it, so
    near-copies of one text cost one comparison each instead of one for each other. No pair is left out for it: what is
    still in different groups is compared later.
    """
    links = groups = None
    sig = reps.select("key", "n", "sig")
    for turn in range(ROUNDS):
        rows = with_group(crowded, groups)
        if turn:
            rows = rows.join(bulks(rows).select("path", F.col("most.group").alias("main")), "path").filter(F.col("group") != F.col("main"))
        leader = rows.groupBy("path").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("hash"), "key", "group")).alias("led"))
        pairs = rows.join(leader, "path").filter(F.col("group") != F.col("led.group")).select(F.col("led.key").alias("leader"), "key").distinct()
        both = pairs.join(sig, "key").join(sig.select(F.col("key").alias("leader"), F.col("n").alias("n_"), F.col("sig").alias("sig_")), "leader")
        same = F.aggregate(F.sequence(F.lit(0), F.lit(HASHES - 1)), F.lit(0), lambda t, k: t + (coordinate(F.col("sig"), k) == coordinate(F.col("sig_"), k)).cast("int"))
        near = fitted(both.filter((F.least("n", "n_") * 100 >= PERCENT * F.greatest("n", "n_")) & (same >= (PERCENT / 100 - SLACK) * HASHES)).select("leader", "key"))
        if near.isEmpty():
            break
        blocks = near.groupBy("leader").agg(F.ceil(F.count("*") / LEAF).alias("blocks"))
        near = near.join(blocks, "leader").withColumn("path", F.xxhash64("leader", F.pmod(F.xxhash64("key"), F.col("blocks"))))
        nodes = fitted(near.select("path", "key", F.lit(1).alias("side")).unionByName(near.select("path", F.col("leader").alias("key"), F.lit(0).alias("side")).distinct()))
        found = fitted(confirmed(nodes.join(sets_of(nodes), "key")))
        links = found if links is None else links.unionByName(found)
        groups = fitted(components(links, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("group")))
    return links, groups


def parted(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds to the rows of nodes: bulk, the sets of the largest group of leaders in the node, rest, those outside, and inside, whether the row is of that group."""
    plain = lambda d: d.select("path", "key", "tree", "size", F.col("size").alias("rest"), F.lit(0).cast("long").alias("bulk"), F.lit(False).alias("inside"))
    if groups is None:
        return plain(rows)
    crowd = with_group(rows.filter(F.col("size") > CROWD), groups)
    crowd = crowd.join(bulks(crowd).filter("most.bulk > 1"), "path", "left")
    bulk = F.coalesce("most.bulk", F.lit(0).cast("long"))
    crowd = crowd.select("path", "key", "tree", "size", (F.col("size") - bulk).alias("rest"), bulk.alias("bulk"), F.coalesce(F.col("group") == F.col("most.group"), F.lit(False)).alias("inside"))
    return plain(rows.filter(F.col("size") <= CROWD)).unionByName(fitted(crowd.filter("rest > 0")))


def leaves(reps: DataFrame, nodes: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Nodes to compare exhaustively: path, key, tree, side, branched. nodes are the roots, groups those of leaders.

    Only pairs with an end outside the largest group of leaders in a node are to be compared. Nodes with more of them than
    a node of LARGE sets has branch until they are smaller. Leaves of more than LEAF sets, and those that are still large
    after LEVELS levels, are cut into blocks, and each pair of blocks is a node of its own (side tells the blocks apart),
    so no such pair of a leaf is left out. tree is the root that a node is, or -1 below the roots; branched has a bit for
    each root of the set that is too large to be compared whole.
    """
    nodes, found = roots(reps) if nodes is None else nodes, None
    for level in range(LEVELS + 1):
        rows = parted(nodes, groups)
        small = F.col("rest") * F.col("size") <= (LARGE * LARGE if level < LEVELS else 1 << 62)
        outer, inner = F.ceil(F.col("rest") / LEAF).cast("int"), F.ceil(F.col("bulk") / LEAF).cast("int")
        own = F.when(F.col("inside"), outer + F.pmod(F.xxhash64("key"), F.greatest(inner, F.lit(1)))).otherwise(F.pmod(F.xxhash64("key"), outer)).cast("int")
        others = F.sequence(F.lit(0), F.when(F.col("inside"), outer).otherwise(outer + inner) - 1)
        some = rows.filter(small).withColumn("own", own).withColumn("other", F.explode(others))
        path = F.when(outer + inner == 1, F.col("path")).otherwise(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")))
        side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
        some = some.select(path.alias("path"), "key", "tree", side.alias("side"), *([F.lit(0).alias("branched")] if level else []))
        found = some if found is None else found.unionByName(some)
        large = rows.filter(~small).select("path", "key", "tree")
        if large.isEmpty():
            return found if level else found.withColumn("branched", F.lit(0))
        if not level:
            found = found.join(large.groupBy("key").agg(F.sum(F.expr("shiftleft(1, tree)")).cast("int").alias("branched")), "key", "left").select("path", "key", "tree", "side", F.coalesce("branched", F.lit(0)).alias("branched"))
        nodes = sized(branch(large, reps).withColumn("tree", F.lit(-1)))


def by_node(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by path, in tables that hold whole nodes and about `most` rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= most:
            t = pa.Table.from_batches(kept).combine_chunks()
            path = t.column("path").to_numpy()
            end = int(np.searchsorted(path, path[-1], "left"))
            if end:
                yield t.slice(0, end)
                kept = t.slice(end).to_batches()
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def with_partners(rows: DataFrame) -> DataFrame:
    """Path, key and side of the rows (path, key, tree, side, branched, n, sig) that may have a partner in their node by size and minwise estimate.

    A pair that shares the token of an earlier root is compared there, unless that root branched, so here only the first
    root that it shares and that is compared whole counts.
    """
    schema = T.StructType([T.StructField("path", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("side", T.IntegerType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_node(batches):
            path, n, tree, side, branched = (t.column(c).to_numpy() for c in ("path", "n", "tree", "side", "branched"))
            whole = (branched[:, None] >> np.arange(TREES) & 1) == 0
            sig = _matrix(t.column("sig"))
            active = np.zeros(len(path), bool)
            step = 1
            while len(at := np.flatnonzero(path[:-step] == path[step:])):
                size = np.minimum(n[at], n[at + step]) * 100 >= PERCENT * np.maximum(n[at], n[at + step])
                at = at[size & ((side[at] < 0) | (side[at] != side[at + step]))]
                same = sig[at] == sig[at + step]
                near = at[(same.mean(1) >= PERCENT / 100 - SLACK) & ((tree[at] < 0) | ((same[:, :TREES] & whole[at]).argmax(1) == tree[at]))]
                active[near] = active[near + step] = True
                step += 1
            yield pa.RecordBatch.from_arrays([pa.array(path[active]), t.column("key").combine_chunks().filter(pa.array(active)).cast(pa.binary()), pa.array(side[active], pa.int32())], schema=out)

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)


def linked(sets: list[np.ndarray], first: int) -> list[tuple[int, int]]:
    """Links of a node on full sets, as a forest that joins what is connected: of the `first` sets with the others, or of all pairs if that is 0."""
    n = np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(n)]
    mark = np.zeros(len(value), np.int32)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a in range(first or len(sets) - 1):
        mine = column[start[a] : start[a + 1]]
        mark[mine] = 1
        at = first or a + 1
        both = np.add.reduceat(mark[column[start[at] :]], start[at:-1] - start[at])
        mark[mine] = 0
        for b in (at + np.flatnonzero(100 * both >= PERCENT * (n[a] + n[at:] - both))).tolist():
            if (p := find(a)) != (q := find(b)):
                root[max(p, q)] = min(p, q)
                out.append((a, b))
    return out


def confirmed(rows: DataFrame) -> DataFrame:
    """Links a, b among the sets of each node (path, key, side, shingles): between its two sides, if it has them."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_node(batches, 512):
            path, side, keys = t.column("path").to_numpy(), t.column("side").to_numpy(), t.column("key").to_pylist()
            found = set()
            start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]).tolist()
            for a, b in zip(start, [*start[1:], len(path)]):
                sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").slice(a, b - a).to_pylist()]
                first = int((side[a:b] == 0).sum())
                if side[a] < 0 or 0 < first < b - a:
                    found.update((keys[a + i], keys[a + j]) for i, j in linked(sets, first))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], schema=out)

    return rows.select("path", "key", "side", "shingles").repartition("path").sortWithinPartitions("path", "side").mapInArrow(run, schema)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: the id, n_shingles, component_id (least id reachable), kept (id = component_id).

    Words are runs of anything but ASCII white space, with A-Z lowered; a set holds the distinct shingles of five words, or
    the whole sequence if it is shorter. Sets with 100 * intersection >= 85 * union are linked. Null and empty texts have
    an empty set and stand alone. Documents with equal sets form one class; classes are joined, so copies are never paired
    with each other. A null id takes no part in the minimum; repeated rows give repeated results.

    The join finds a link with the probability that one of TREES random trees keeps both sets together; all that it
    reports is checked on full sets. In crowded nodes near-copies of one text are first joined by leaders, and pairs that
    those have joined are not compared again. A task compares two blocks of LEAF sets at most, so none needs a large group.
    """
    found = cut(features(df, id_col, text_col, False))
    reps = fitted(found.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig")))

    def sets_of(keys: DataFrame) -> DataFrame:
        need = fitted(reps.join(keys.select("key").distinct(), "key", "left_semi").select(F.col("id").alias("need_")).distinct())
        need = F.broadcast(need) if need.count() <= FETCH_ROWS else need
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(need, F.col("id").eqNullSafe(F.col("need_")), "left_semi")
        return features(texts, "id", "text", True).select("key", "shingles").dropDuplicates(["key"])

    nodes = roots(reps)
    crowded = fitted(nodes.filter(F.col("size") > CROWD).select("path", "key"))
    star, groups = (None, None) if crowded.isEmpty() else led(crowded, reps, sets_of)
    near = fitted(with_partners(leaves(reps, nodes, groups).join(reps.select("key", "n", "sig"), "key")))
    links = confirmed(near.join(sets_of(near), "key"))
    links = links if star is None else links.unionByName(star)
    joined = components(links, "a", "b")
    classes = reps.select("key", "id").join(joined.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("id").alias("component"))
    named = classes.join(least, "root").select("key", "component")
    out = found.select("id", "n", "key").join(named, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def queries() -> dict:
    return {"op4_minhash_near_dedup": lambda spark, sf_dir: near_groups(table(spark, sf_dir, "documents"))}
