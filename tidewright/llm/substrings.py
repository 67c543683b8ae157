"""Suffix-array dedup: passages of a set length that stand more than once are cut from every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, table

#: Bytes of a repeated string, and of the grams that anchor its windows.
LENGTH, GRAM = 200, 64
GRAMS = LENGTH - GRAM + 1
#: Window starts that are anchored together; bytes that are sorted together.
BLOCK, SORTED = 1 << 22, 1 << 20
#: Distinct contexts of one anchor that fit into one sort; beyond it windows are counted by hash.
CONTEXTS = SORTED // (LENGTH + GRAMS - 1)
#: Parts over which the rows of a frequent anchor are spread.
SALTS = 256

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    return h ^ (h >> np.uint64(29))


def window_hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all grams and of all windows, by doubling."""
    h, by = t.astype(np.uint64) + np.uint64(1), {}
    for k in range(7):
        h = h[: len(h) - (1 << k)] * ODD[k] + h[1 << k :]
        h ^= h >> np.uint64(31)
        by[2 << k] = h
    n = len(t) - LENGTH + 1
    return _mixed(by[64]), _mixed((by[128][:n] * ODD[0] + by[64][128 : 128 + n]) * ODD[1] + by[8][192 : 192 + n])


def anchors(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts the window starts of a text into runs that share an anchor: the least gram of the window, the leftmost of equals.

    Equal windows have equal anchors at equal places, whatever stands around them. Gives start, last start, place of the
    anchor, its hash, and a hash of the whole run's bytes.
    """
    found = []
    for a in range(0, max(0, len(t) - LENGTH + 1), BLOCK):
        part = t[a : a + BLOCK + LENGTH - 1]
        grams, windows = window_hashes(part)
        least = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        for k in range(7):
            least = np.minimum(least[: len(least) - (1 << k)], least[1 << k :])
        least = np.minimum(least[: len(windows)], least[GRAMS - 128 : GRAMS - 128 + len(windows)])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:], len(at)] - 1
        context = _mixed((windows[lo] * ODD[1] + windows[hi]) * ODD[2] + (hi - lo).astype(np.uint64))
        found.append((lo + a, hi + a, at[lo] + a, grams[at[lo]].view(np.int64), context.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Two-stage suffix sorting, to a depth of LENGTH bytes at least.

    Suffixes smaller than their successors are sorted directly. The others follow by one scan of the buckets of first
    bytes in ascending order: whatever stands at the scan puts its predecessor, if that is larger, next in its bucket.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16)))
    step = np.r_[step, 1]
    known = np.where(step != 0, np.arange(n), n)
    larger = step[np.minimum.accumulate(known[::-1])[::-1]] < 0  # equal bytes have the type of the next change
    small = np.flatnonzero(~larger)
    padded = np.r_[t, np.zeros(LENGTH, np.uint8)]
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[small]).view(f"S{LENGTH}").ravel()
    small = small[np.argsort(keys, kind="stable")]
    ends = np.searchsorted(t[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(some: np.ndarray, at: int) -> np.ndarray:
        before = some[some > 0] - 1
        before = before[larger[before]]
        first = t[before]
        own = before[first == at]
        if len(own) < len(before):
            before, first = before[first != at], first[first != at]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece in np.split(before, cuts):
                waiting[t[piece[0]]].append(piece)
        return own

    for c in range(256):
        some = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(some):
            out.append(some)
            some = induce(some, c)
        some = small[ends[c] : ends[c + 1]]
        if len(some):
            out.append(some)
            induce(some, c)
    return np.concatenate(out)


def repeated(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context a mask of the window starts whose string stands in another place of these contexts."""
    t = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    valid = np.zeros(len(t), bool)
    for a, n in zip(start.tolist(), size.tolist()):
        valid[a : a + n - LENGTH + 1] = True
    order = suffix_order(t)
    order = order[valid[order]]
    windows = np.lib.stride_tricks.sliding_window_view(t, LENGTH)
    mark = np.zeros(len(t), bool)
    for a in range(0, len(order) - 1, 50_000):  # common prefixes of neighbours, as far as LENGTH
        x, y = order[a : a + 50_000], order[a + 1 : a + 50_001]
        x = x[: len(y)]
        same = (windows[x] == windows[y]).all(1)
        mark[x[same]] = mark[y[same]] = True
    return [mark[a : a + n - LENGTH + 1] for a, n in zip(start.tolist(), size.tolist())]


def runs(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)


PLACE = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
SPANS = T.StructType([*PLACE, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))


def anchored(docs: DataFrame) -> DataFrame:
    """A row for each run of window starts: id, k1, k2, anchor, context, run (start, length and place of the anchor, packed)."""
    schema = T.StructType([docs.schema["id"], *PLACE, *(T.StructField(n, T.LongType()) for n in ("anchor", "context", "run"))])
    out = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, made = [], []
            for k, x in enumerate(b.column(3)):
                lo, hi, at, anchor, context = anchors(np.frombuffer(x.as_py().encode(), np.uint8))
                which.append(np.full(len(lo), k))
                made.append((anchor, context, lo << 16 | (hi - lo) << 8 | (at - lo)))
            if which:
                which = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(which).cast(f.type) for k, f in zip(range(3), out)), *(pa.array(np.concatenate(c)) for c in zip(*made))], schema=out)

    return docs.select("id", "k1", "k2", "text").mapInArrow(work, schema)


def _run(row: str = "run") -> list:
    """Start and end of the bytes that a run's windows cover."""
    lo = F.shiftright(row, 16)
    return [lo.alias("start"), (lo + F.shiftright(row, 8).bitwiseAND(F.lit(255)) + LENGTH).alias("end")]


def fetched(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes of contexts (id, k1, k2, anchor, run, n, k)."""
    need = contexts.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct("anchor", "run", "n", "k")).alias("runs")).select(F.col("id").alias("id_"), F.col("k1").alias("a_"), F.col("k2").alias("b_"), "runs")
    rows = docs.join(need, docs["id"].eqNullSafe(F.col("id_")) & (F.col("k1") == F.col("a_")) & (F.col("k2") == F.col("b_"))).select("k1", "k2", F.col("text").cast("binary").alias("raw"), F.explode("runs").alias("r"))
    span = _run("r.run")
    return rows.select("k1", "k2", F.col("r.anchor").alias("anchor"), F.col("r.run").alias("run"), F.col("r.n").alias("n"), F.col("r.k").alias("k"), F.substring("raw", (span[0] + 1).cast("int"), (span[1] - span[0]).cast("int")).alias("bytes"))


def sorted_spans(contexts: DataFrame) -> DataFrame:
    """Spans of repeated windows among contexts that share an anchor, by suffix arrays over about SORTED bytes at a time."""
    out = arrow_schema(SPANS)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(a, k1, k2, run): (n, raw) for a, k1, k2, run, n, raw in rows}.items())
        found = []
        for ((_, k1, k2, run), (n, raw)), mask in zip(rows, repeated([raw for _, (_, raw) in rows])):
            if n == 1:
                found += [(k1, k2, (run >> 16) + a, (run >> 16) + b - 1 + LENGTH) for a, b in runs(mask).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], schema=out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if size >= SORTED and row[0] != last:
                    yield flush(kept)
                    kept, size = [], 0
                kept.append(row)
                size, last = size + len(row[5]), row[0]
        if kept:
            yield flush(kept)

    return contexts.select("anchor", "k1", "k2", "run", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(work, SPANS)


def counted_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted by hash, anchor and place of the anchor, so no task holds a group."""
    schema = T.StructType([*PLACE, *(T.StructField(n, T.LongType()) for n in ("anchor", "place", "window", "start"))])
    out = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for anchor, k1, k2, run, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                h = window_hashes(np.frombuffer(raw, np.uint8))[1].view(np.int64)
                at = np.arange(len(h))
                made.append((np.full(len(h), k1), np.full(len(h), k2), np.full(len(h), anchor), (run & 255) - at, h, (run >> 16) + at))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], schema=out)

    rows = contexts.dropDuplicates(["anchor", "k1", "k2", "run"]).select("anchor", "k1", "k2", "run", "bytes").mapInArrow(work, schema)
    keys = ["anchor", "place", "window"]
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
    return rows.join(twice, keys).select("k1", "k2", "start", (F.col("start") + LENGTH).alias("end"))


def salted(by: DataFrame, keys: list[str]) -> tuple[Column, DataFrame]:
    """Spreads frequent keys of a table of counts (keys, n_) over SALTS parts: a column for the rows that are to meet it, and the table with salt_.

    A key is frequent if it has a 1/SALTS of all rows, so there are SALTS such keys at most, which the column lists.
    """
    total = by.agg(F.sum("n_")).first()[0] or 0
    often = [r["h"] for r in by.filter(F.col("n_") * SALTS > total).select(F.xxhash64(*keys).alias("h")).collect()]  # SALTS at most
    if not often:
        return F.lit(0), by.withColumn("salt_", F.lit(0))
    frequent = F.xxhash64(*keys).isin(often)
    salt = F.when(frequent, F.pmod(F.xxhash64("k1", "k2", "run"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return salt, by.withColumn("salt_", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Byte spans k1, k2, start, end that are covered by strings standing more than once; spans may overlap.

    Runs of windows with equal anchors and equal bytes need no text. Only an anchor with different contexts has one of
    each compared.
    """
    rows = anchored(docs)
    by = cut(rows.groupBy("anchor").agg(F.count("*").alias("n_"), F.min("context").alias("least"), F.max("context").alias("most")).filter("n_ > 1"))
    salt, by = salted(by, ["anchor"])
    rows = cut(rows.withColumn("salt_", salt).join(by, ["anchor", "salt_"]).select("id", "k1", "k2", "anchor", "context", "run", (F.col("least") == F.col("most")).alias("one")))
    equal = rows.filter("one").select("k1", "k2", *_run())
    mixed = rows.filter("not one")
    contexts = mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "run", "id")).alias("rep"))
    many = contexts.groupBy("anchor").agg(F.count("*").alias("k"))
    contexts = cut(contexts.join(many, "anchor").select("anchor", "context", "n", "k", "rep.*"))
    salt, twice = salted(contexts.filter("n > 1").select("anchor", "context", F.col("n").alias("n_")), ["anchor", "context"])
    again = mixed.withColumn("salt_", salt).join(twice, ["anchor", "context", "salt_"], "left_semi").select("k1", "k2", *_run())
    some = cut(fetched(docs, contexts))
    few = sorted_spans(some.filter(F.col("k") <= CONTEXTS))
    lots = counted_spans(some.filter(F.col("k") > CONTEXTS))
    return equal.unionByName(again).unionByName(few).unionByName(lots).distinct()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts every byte that is covered by a LENGTH-byte string that also starts anywhere else, in the same text or another.

    Columns: the id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the other bytes). All occurrences go, and
    strings are judged on the input. A null or empty text, or one shorter than LENGTH, loses nothing. Rows with equal
    texts have equal results, and rows that repeat count as occurrences of one another.

    Texts move twice at most: those that hold an anchor with different surroundings, and all of them to meet their spans.
    """
    docs = keyed(df, id_col, text_col)
    span = F.struct("start", "end")
    spans = repeated_spans(docs).groupBy("k1", "k2").agg(F.collect_list(span).alias("spans"))
    rows = docs.join(spans, ["k1", "k2"], "left").select("id", "text", "spans.start", "spans.end")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    out = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x, start, end in zip(b.column(1), b.column(2), b.column(3)):
                raw = x.as_py().encode()
                if start.as_py() is None:
                    made.append((len(raw), 0, 0, raw))
                    continue
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, start.values.to_numpy(), 1)
                np.add.at(depth, end.values.to_numpy(), -1)
                gone = np.cumsum(depth[:-1]) > 0
                made.append((len(raw), int(gone.sum()), len(runs(gone)), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(out[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*made), list(out)[1:]))], schema=out)

    return rows.mapInArrow(work, schema)


def _op10(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op10_suffix_array_dedup": _op10}
