"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson on distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, cut, table

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors of the search space for each wanted component: at the start and after a cut, and before one.
START, MOST = 2, 6
#: MINRES steps for one correction at most, and the part of a residual at which they end.
INNER, ENOUGH = 3, 0.05
#: A residual of so many roundings (of the largest eigenvalue, times the root of the dimensions) is double precision.
ROUNDINGS = 4
#: Rounds without any progress beyond which residuals can't fall further; they must then be below LEAST of the largest eigenvalue.
STALE, LEAST = 4, 1e-12
#: Residual (of the largest eigenvalue) at which the search for a missed value ends.
ROUGH = 1e-5
#: Ritz pairs that a search for one value corrects at once.
BLOCK = 8
EPS = float(np.finfo(float).eps)


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Adds vec_, the entries as doubles, and drops rows whose vector is null or has null or non-finite entries, or another length than most vectors (of equally frequent lengths the greatest)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.withColumn("vec_", v).filter(F.col("vec_").isNotNull() & ~bad)
    length = rows.groupBy(F.size("vec_").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # one row
    return rows.filter(F.size("vec_") == (length["n"] if length else 0))


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers from an Arrow list of doubles."""
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(SCALE)).reshape(len(vectors), dims)
    if scaled.size and np.abs(scaled).max() >= 2.0**53:
        raise ValueError("an entry is too large for exact sums")
    return scaled.astype(np.int64) + SHIFT


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """The whole numbers of all vectors as blocks of bytes, some hundred rows each, cut: every product reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(0), dims)
            small = x.size == 0 or np.abs(x).max() < 2**31
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary()), pa.array([4 if small else 8], pa.int32())], names=["x", "width"])

    return cut(rows.select("vec_").mapInArrow(run, "x binary, width int"))


class Fit:
    """Sums over all vectors. Each pass is one Spark job: every task adds up its own blocks, and Spark adds the tasks' sums by place."""

    def __init__(self, blocks: DataFrame, dims: int) -> None:
        self.blocks, self.dims = blocks, dims
        self.n, self.sums, self.whole, self.rest = 0, [0] * dims, np.zeros(dims, np.int64), np.zeros(dims)
        found = self._added(lambda x: np.append(x.sum(axis=0), len(x)), dims + 1, "long")
        self.n, self.sums = int(found[-1]), [int(s) for s in found[:-1]]
        if self.n:
            self.whole = np.array([s // self.n for s in self.sums], np.int64)
            self.rest = np.array([s % self.n / self.n for s in self.sums])

    def _added(self, fn: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> list:
        """The sum of `fn(block)`, `size` numbers, over all blocks; longs are added exactly."""
        dims, dtype = self.dims, np.int64 if kind == "long" else np.float64

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype)
            for batch in batches:
                for x, width in zip(batch.column(0), batch.column(1)):
                    total += fn(np.frombuffer(x.as_buffer(), f"<i{width.as_py()}").astype(np.int64).reshape(-1, dims))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

        parts = self.blocks.mapInArrow(run, f"place int, value {kind}")
        value = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
        found = dict(parts.groupBy("place").agg(F.sum(value)).collect())  # `size` rows, whatever the number of vectors
        return [found.get(k, 0) for k in range(size)]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """A block less the mean, each entry rounded once."""
        whole, rest = self.whole, self.rest
        return lambda x: (x - whole) - rest

    def times(self, u: np.ndarray) -> np.ndarray:
        """The covariance times the columns of u, without the covariance."""
        centred, shape, n = self.centred(), u.shape, self.n

        def fn(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return (y.T @ (y @ u)).ravel()

        return np.array(self._added(fn, u.size)).reshape(shape) / n

    def trace(self) -> float:
        centred = self.centred()
        return float(self._added(lambda x: np.square(centred(x)).sum(keepdims=True).ravel(), 1)[0]) / self.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """The covariance of the centred vectors' projections, which are centred once more."""
        centred, k, n = self.centred(), projection.shape[1], self.n
        mean = np.array(self._added(lambda x: (centred(x) @ projection).sum(axis=0), k)) / n

        def fn(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ projection - mean
            return (w.T @ w).ravel()

        return np.array(self._added(fn, k * k)).reshape(k, k) / n


def orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of t made orthonormal, to each other and to those of `against`; those that hardly leave their span go."""
    out = np.zeros((len(t), 0))
    for c in t.T:
        size = np.linalg.norm(c)
        if not size > 0:
            continue
        c = c / size
        for _ in range(3):
            for q in (*against, out):
                c = c - q @ (q.T @ c)
            size = np.linalg.norm(c)
            if size < 1e-10:
                break
            c = c / size
        else:
            out = np.c_[out, c]
    return out


def corrections(times: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """Corrections of all Ritz vectors u, by MINRES on (I - PP')(V - theta I)(I - PP') t = -r, where P holds u and what is locked.

    The systems go in step, so that a step of all is one distributed product.
    """

    def apart(t: np.ndarray, cols: np.ndarray) -> np.ndarray:
        t = t - locked @ (locked.T @ t)
        return t - u[:, cols] * (u[:, cols] * t).sum(axis=0)

    norm = lambda a: np.sqrt((a * a).sum(axis=0))
    k = u.shape[1]
    y = apart(-r, np.arange(k))
    first, last, x, w, w_last = y.copy(), y.copy(), np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    beta = norm(y)
    start, left = beta.copy(), beta.copy()
    beta_last, dbar, eps, cs, sn = np.ones(k), np.zeros(k), np.zeros(k), -np.ones(k), np.zeros(k)
    live = np.flatnonzero(beta > 0)
    for step in range(INNER):
        if not len(live):
            break
        a = live
        v = y[:, a] / beta[a]
        z = apart(times(v) - theta[a] * v, a)
        if step:
            z -= beta[a] / beta_last[a] * first[:, a]
        alpha = (v * z).sum(axis=0)
        z -= alpha / beta[a] * last[:, a]
        first[:, a], last[:, a], y[:, a] = last[:, a], z, z
        beta_last[a] = beta[a]
        beta[a] = norm(z)
        eps_last = eps[a]
        delta, gbar = cs[a] * dbar[a] + sn[a] * alpha, sn[a] * dbar[a] - cs[a] * alpha
        eps[a], dbar[a] = sn[a] * beta[a], -cs[a] * beta[a]
        gamma = np.maximum(np.hypot(gbar, beta[a]), np.finfo(float).tiny)
        cs[a], sn[a] = gbar / gamma, beta[a] / gamma
        phi = cs[a] * left[a]
        left[a] = sn[a] * left[a]
        new = (v - eps_last * w_last[:, a] - delta * w[:, a]) / gamma
        w_last[:, a], w[:, a] = w[:, a], new
        x[:, a] += phi * new
        live = a[(left[a] > ENOUGH * start[a]) & (beta[a] > EPS * np.abs(theta[a]))]
    return apart(x, np.arange(k))


def search(times: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, values: np.ndarray, wanted: int, rng: np.random.Generator, rough: float = 0.0, block: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi-Davidson: adds to `locked` (eigenvectors, with their `values`) the `wanted` leading ones of what is orthogonal to it.

    A search space gives Ritz pairs (Rayleigh-Ritz). Pairs whose residual is at double precision (or at `rough` times the
    largest value) are locked, from the largest on; the others' corrections extend the space, which is cut back to its
    best Ritz vectors when it has grown. `block` pairs at least are corrected at once.
    """
    dims, left = len(locked), wanted
    start, most = START * max(wanted, block), MOST * max(wanted, block)
    space = orthonormal(rng.normal(size=(dims, min(start, dims - locked.shape[1]))), locked)
    image, best, stale = times(space), np.inf, 0
    while left:
        h = space.T @ image
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(abs(ritz[0]), np.abs(values).max(initial=0))
        u, theta = space[:, :left], ritz[:left]
        r = image[:, :left] - u * theta
        r -= locked @ (locked.T @ r)
        size = np.sqrt((r * r).sum(axis=0))
        stale = 0 if size.sum() < 0.5 * best else stale + 1
        best = min(best, size.sum())
        enough = max(ROUNDINGS * EPS * np.sqrt(dims) * top, rough * top, LEAST * top if stale >= STALE else 0.0)
        done = int(np.argmax(size > enough)) if (size > enough).any() else left
        if done:
            locked, values, left = np.c_[locked, u[:, :done]], np.append(values, theta[:done]), left - done
            space, image, best, stale = space[:, done:], image[:, done:], np.inf, 0
            u, theta, r = u[:, done:], theta[done:], r[:, done:]
            if not left:
                break
        elif stale > 50 * STALE:
            raise ArithmeticError(f"residuals of {size.max()} don't fall")
        if left < block:
            u, theta = space[:, :block], ritz[done:][:block]
            r = image[:, :block] - u * theta
            r -= locked @ (locked.T @ r)
        new = corrections(times, theta, u, r, locked)
        if space.shape[1] + new.shape[1] > most:
            space, image = space[:, : max(start, left)], image[:, : max(start, left)]
        found = orthonormal(np.c_[new, r], locked, space)[:, : new.shape[1]]
        if not found.shape[1]:
            found = orthonormal(rng.normal(size=(dims, min(left, dims - locked.shape[1] - space.shape[1]))), locked, space)
        if found.shape[1]:
            space, image = np.c_[space, found], np.c_[image, times(found)]
    return locked, values


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric operator (all, if there are fewer), falling, their unit eigenvectors and residuals.

    A search space can miss a copy of a multiple eigenvalue. So a second search, from random vectors orthogonal to all
    found, asks for a larger value, until there is none. The largest entry of each eigenvector is positive.
    """
    wanted, rng = min(wanted, dims), np.random.default_rng(seed)
    vectors, values = search(times, np.zeros((dims, 0)), np.zeros(0), wanted, rng)
    while wanted < dims:
        least = values.min() + ROUNDINGS * EPS * np.sqrt(dims) * values.max()
        if search(times, vectors, values, 1, rng, ROUGH, BLOCK)[1][-1] <= least:
            break
        vectors, values = search(times, vectors, values, 1, rng, 0.0, BLOCK)
        kept = np.delete(np.arange(wanted + 1), values.argmin())
        vectors, values = vectors[:, kept], values[kept]
    image = times(vectors)
    h = vectors.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, vectors, image = values[::-1], vectors @ turn[:, ::-1], image @ turn[:, ::-1]
    scale = np.linalg.norm(vectors, axis=0)
    vectors, image = vectors / scale, image / scale
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)
    return values, vectors * signs, np.linalg.norm(image - vectors * values, axis=0)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: a row for each vector and component, numbered from 1 by falling eigenvalue.

    The fit list is all vectors that take part: rows whose vector is null or holds null or non-finite entries don't, nor
    does a vector of another length than most. Gives the id, component, n (vectors of the list), deviation (decimal; the sum of
    (n x - S)^2 over the dimensions, exact), whitened (the centred x on the component, over the root of its eigenvalue),
    explained (the eigenvalue's share of the covariance's trace), identity_error (the largest absolute entry of whitened's
    covariance less the identity, one number) and residual. A component without variance (an eigenvalue at rounding, as when
    there are fewer vectors than components) has explained 0 and whitened null, and doesn't count in identity_error, which is
    null if there is none else. With fewer dimensions there are as many components. Each of repeated rows or ids has its own
    rows; an empty table gives none. Entries of 2^43 and more are an error, as their sums would not be exact.

    Vectors are read once, packed and checkpointed; each product over all of them is a job that returns dims times the
    number of columns. Nothing that grows with the number of vectors leaves the tasks.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType
    rows = usable(df.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{vec_col}`").alias("raw_")), "raw_")
    first = rows.select(F.size("vec_")).first()
    schema = T.StructType([T.StructField("id_", id_type), *T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])
    out = [F.col("id_").alias(id_col), F.col("component"), F.col("n"), F.col("deviation"), F.col("whitened"), F.col("explained"), F.col("identity_error"), F.col("residual")]
    if not first or not first[0]:
        return spark.createDataFrame([], T.StructType([schema[0], *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double").fields])).select(*out)
    dims = first[0]
    fit = Fit(packed(rows, dims), dims)
    values, vectors, residuals = leading(fit.times, dims, components)
    trace = fit.trace()
    real = values > 1e-13 * max(trace, 0.0) if trace > 0 else np.zeros(len(values), bool)
    projection = vectors[:, real] / np.sqrt(values[real])
    error = float(np.abs(fit.covariance_of(projection) - np.eye(int(real.sum()))).max()) if real.any() else None
    n, sums, whole, centred, target = fit.n, fit.sums, fit.whole, fit.centred(), arrow_schema(schema)
    over = np.array([s % n for s in sums], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dims)
            a = x - whole
            if a.size and float(np.abs(a).max()) * n * dims < 2.0**62:  # n x - S = n a - over
                cross, square = (a * over.astype(np.int64)).sum(axis=1).astype(object), None
            else:
                cross, square = (a.astype(object) * over).sum(axis=1), (a.astype(object) ** 2).sum(axis=1)
            if square is None:
                square = (a * a).sum(axis=1).astype(object) if float(np.abs(a).max()) ** 2 * dims < 2.0**62 else (a.astype(object) ** 2).sum(axis=1)
            deviation = n * n * square - 2 * n * cross + int((over * over).sum())
            scores = np.full((len(x), len(values)), np.nan)
            scores[:, real] = centred(x) @ projection
            lists = [[None if np.isnan(s) else float(s) for s in row] for row in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target[0].type), pa.array([int(d) for d in deviation], pa.decimal128(38, 0)), pa.array(lists, target[2].type)], schema=target)

    made = rows.select("id_", "vec_").mapInArrow(run, schema).select("id_", "deviation", F.posexplode("whitened").alias("at_", "whitened"))
    by = lambda numbers: F.get(F.array(*(F.lit(float(x)) for x in numbers)), F.col("at_"))
    shares = values / trace if trace > 0 else np.zeros(len(values))
    return made.withColumns({"component": (F.col("at_") + 1).cast("int"), "n": F.lit(n).cast("long"), "explained": by(np.where(real, shares, 0.0)), "identity_error": F.lit(error).cast("double"), "residual": by(residuals)}).select(*out)


def _op13(spark, sf_dir):
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"), "residual")


def queries() -> dict:
    return {"op13_embedding_whitening": _op13}
