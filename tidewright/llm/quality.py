"""Quality classifier: a sparse ensemble of rules from tree paths, compiled to Spark column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bound of the labelled rows that the rules are fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, LEAST = 24, 3, 32, 10
#: Weight of the lasso penalty.
PENALTY = 2e-3
STATISTICS = ("chars", "symbols", "digits", "capitals", "spaces", "word_length", "longest_word", "distinct_words", "distinct_lines", "stops")


def with_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """Adds a struct `stats` of doubles about each whole text; a null text counts as empty. Only JVM functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    df = df.withColumns({"words_": F.split(F.lower(F.trim(text)), r"\s+"), "lines_": F.split(text, "\n")})
    words = F.size("words_").cast("double")
    columns = [
        F.length(text).cast("double"),
        rest(r"[\p{L}\p{N}\s]+") / n,
        rest(r"[^0-9]+") / n,
        rest(r"[^\p{Lu}]+") / n,
        rest(r"\S+") / n,
        F.length(text) / words,
        F.array_max(F.transform("words_", F.length)).cast("double"),
        F.size(F.array_distinct("words_")) / words,
        F.size(F.array_distinct("lines_")) / F.size("lines_").cast("double"),
        rest(r"[^.!?]+") / words,
    ]
    return df.withColumn("stats", F.struct(*(c.alias(s) for c, s in zip(columns, STATISTICS)))).drop("words_", "lines_")


def grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, found: list, out: np.ndarray) -> None:
    """Grows one tree by the gain of Newton steps; notes the path of each node as a rule."""
    value = residual[rows].sum() / (hessian[rows].sum() + 1.0)
    if path:
        found.append(path)
    best = (1e-6, None, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        g, h = residual[rows].sum(), hessian[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[rows, f], side="left")  # bin k holds values up to cut k
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (residual[rows], hessian[rows], None))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), f, c[gain.argmax()])
    if best[1] is None:
        out[rows] = value
        return
    _, f, c = best
    low = x[rows, f] <= c
    grow(x, cuts, residual, hessian, rows[low], (*path, (f, True, float(c))), found, out)
    grow(x, cuts, residual, hessian, rows[~low], (*path, (f, False, float(c))), found, out)


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return reduce(and_, ((x[:, f] <= c) if low else (x[:, f] > c) for f, low, c in rule))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Rules of boosted trees, then logistic weights with a lasso penalty (accelerated proximal steps)."""
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = np.log(prior / (1 - prior))
    if len(y) < 4 * LEAST or y.min() == y.max():
        return {"bias": bias, "rules": []}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    score, found = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        grow(x, cuts, y - p, p * (1 - p), np.arange(len(y)), (), found, step)
        score += 0.3 * step
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in found))
    z = np.stack([holds(x, r) for r in rules], 1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[k] for k in sorted(first)], z[:, sorted(first)]
    mean = z.mean(0)
    z = z - mean
    weight, ahead, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    rate = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    for _ in range(400):
        p = 1 / (1 + np.exp(-(bias + z @ ahead)))
        bias += 2 * (y - p).mean()
        new = ahead + rate * (z.T @ (y - p)) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * PENALTY)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - weight)
        weight = new
    return {"bias": float(bias - mean @ weight), "rules": [(r, float(w)) for r, w in zip(rules, weight) if abs(w) > 1e-6]}


def compiled(model: dict, stats: str = "stats") -> Column:
    """The ensemble as one column: a bias, and a weight wherever a rule's conditions all hold."""
    total = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        terms = [(F.col(stats)[STATISTICS[f]] <= c) if low else (F.col(stats)[STATISTICS[f]] > c) for f, low, c in rule]
        total = total + F.when(reduce(and_, terms), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Learns from at most TRAIN_ROWS labelled rows (lowest hash of the id) whose crc32(id) mod 3 is not 1.

    The sample's ids are bounded, so they are broadcast: texts aren't shuffled, and statistics are made for the sample alone.
    """
    text_id = F.col(id_col).cast("string")
    some = labels.filter((F.crc32(text_id.cast("binary")) % 3 != 1) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).alias("label_"))
    some = some.orderBy(F.xxhash64("id_"), "id_").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(some), "id_")
    rows = with_statistics(rows, "text_").select("id_", "label_", "stats.*").orderBy("id_", "label_", *STATISTICS).limit(2 * TRAIN_ROWS).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["label_"].to_numpy(float))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every text: the id, score (0 to 1) and predicted (1 from 0.5). Null counts as empty, which has a score too. No shuffle.

    Whole texts of any length count; repeated rows give repeated results, an empty table none.
    """
    stats = with_statistics(df.select(F.col(id_col), F.col(text_col).alias("text_")), "text_")
    # the barrier keeps the statistics from being written out anew in each rule
    return stats.select(id_col, "stats").filter(F.col("stats").isNotNull()).withColumn("score", compiled(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("stats")


def _op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", held, "score", "predicted")


def queries() -> dict:
    return {"op7_quality_rules": _op7}
