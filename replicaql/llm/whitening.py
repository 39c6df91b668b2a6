"""Embedding whitening (12): the leading principal components by matrix-free block subspace iteration.

A vector becomes integers x = floor(64 c) + 1000000, so counts and sums are exact. Components are fitted on the distinct
x: a pass of Spark centres the rows and adds up X'(XQ) for a block Q of orthonormal columns, without the covariance itself; sums
meet in MEETING tasks first, so the driver sees that many blocks at most. QR gives
the next block, and Rayleigh-Ritz on the block gives eigenpairs; the residuals |Vq - eq| certify all k before
they are used. The block holds four times k columns: with at most as many dimensions it spans them all, and one pass is exact.

Defined results: rows whose vector is null or holds null or non-finite entries go, and so do empty vectors, those of another
length than the most frequent one (of two, the shorter), and those with an entry of 2**52 or more, whose x no long holds; rows that repeat an id or a vector stay
rows of their own; null ids stay. Components are at most k, the dimensions, and those of an eigenvalue above
RANK of the largest: no others can be scaled to variance 1, so one distinct vector gives no rows, and neither does an empty
table. Each component's largest entry is positive. A deviation that no long holds is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT = 64, 1_000_000
RANK, TOLERANCE, PASSES = 1e-12, 1e-13, 2_000
#: Tasks in which the sums of all tasks meet.
MEETING = 32


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x (longs) of the rows that remain."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 52))) & (F.size(v) > 0), F.lit(False))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(fine).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), dim)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they hold it, else in Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(float) / n


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of rows m (doubles), at least one: tasks' sums meet in MEETING tasks, and theirs in the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            one = _matrix(b.column(0), width).sum(0)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["m"])

    rows = parts.repartition(MEETING).mapInArrow(add, "m array<double>").collect()
    return np.sum([r["m"] for r in rows], 0)


def _totals(fit: DataFrame, dim: int) -> list[int]:
    """The number of rows and the sums of x, exact: tasks add halves of 32 bits, and their sums travel as decimal text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for b in batches:
            x = _matrix(b.column(0), dim)
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            total = [total[0] + len(x), *[t + (h << 32) + w for t, h, w in zip(total[1:], high, low, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]])], names=["m"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for b in batches:
            for row in b.column(0).to_pylist():
                total = [t + int(v) for t, v in zip(total, row, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]])], names=["m"])

    rows = fit.select("x").mapInArrow(add, "m array<string>").repartition(MEETING).mapInArrow(meet, "m array<string>").collect()
    return [sum(map(int, c)) for c in zip(*[r["m"] for r in rows], strict=True)]


def product(fit: DataFrame, q: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """V q by one pass: the covariance of the fit list's x (divisor n) times a block of columns."""
    held, dim = fit.sparkSession.sparkContext.broadcast(q), len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(held.value)
        for b in batches:
            c = _centred(_matrix(b.column(0), dim), n, sums)
            total += c.T @ (c @ held.value)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    return _added(fit.select("x").mapInArrow(run, "m array<double>"), q.size).reshape(q.shape) / n


def components(fit: DataFrame, dim: int, n: int, sums: list[int], k: int, block: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns), certified by their residuals."""
    k, block = min(k, dim), min(dim, block)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, block)))[0]
    for _ in range(PASSES):
        z = product(fit, q, n, sums)
        t = q.T @ z
        e, y = np.linalg.eigh((t + t.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        ritz, image = q @ y[:, :k], z @ y[:, :k]
        residual = np.linalg.norm(image - ritz * e[:k], axis=0)
        if residual.max() <= TOLERANCE * dim * max(e[0], 0.0):
            sign = np.sign(ritz[np.abs(ritz).argmax(0), np.arange(k)])
            return e[:k], ritz * sign
        q = np.linalg.qr(z @ y)[0]
    raise ArithmeticError(f"residuals of {residual.max() / e[0]:.1e} after {PASSES} passes: widen the block")


class Whitening:
    """What the fit found: n, sums S, components (columns), their eigenvalues and the trace."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace

    def whiten(self, dev: np.ndarray) -> np.ndarray:
        return (dev.astype(float) / self.n) @ self.vectors / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, dim: int, k: int = 16, block: int | None = None) -> Whitening:
    """fit: distinct x of one length, at least one."""
    n, *s = _totals(fit, dim)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((float((_centred(_matrix(b.column(0), dim), n, s) ** 2).sum()) for b in batches), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([[total]], pa.list_(pa.float64()))], names=["m"])

    trace = float(_added(fit.select("x").mapInArrow(squares, "m array<double>"), 1)[0]) / n
    if trace <= 0:
        return Whitening(n, s, np.zeros((dim, 0)), np.zeros(0), 0.0)
    e, vectors = components(fit, dim, n, s, k, block or 4 * k)
    kept = e > RANK * e[0]
    return Whitening(n, s, vectors[:, kept], e[kept], trace)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by a pass of its own."""
    dim, k = model.vectors.shape
    held = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = held.value, np.zeros(k * k + k)
        for b in batches:
            w = m.whiten(_deviations(_matrix(b.column(0), dim), m.n, m.sums))
            total += np.r_[(w.T @ w).ravel(), w.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["m"])

    total = _added(fit.select("x").mapInArrow(run, "m array<double>"), k * k + k) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, block: int | None = None) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of each remaining row and component."""
    spark = df.sparkSession
    kinds = f"id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(integers(df, id_col, vec_col), "integers")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], kinds)
    dim = common["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = written(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, dim, k, block)
    found = len(model.values)
    if not found:
        return spark.createDataFrame([], kinds)
    error, held = identity_error(fit, model), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                dev = _deviations(_matrix(b.column(1), dim), m.n, m.sums)
                if dev.dtype != object and np.abs(dev).max(initial=0) >= math.isqrt((1 << 62) // dim):
                    dev = dev.astype(object)
                far = [int(v) if v < 1 << 63 else None for v in (dev * dev).sum(1)]
                size, shares = len(b), np.tile(m.values / m.trace, len(b))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(size), found))), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), size)), pa.array(np.full(size * found, m.n)),
                     pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(size), found))), pa.array(m.whiten(dev).ravel()), pa.array(shares), pa.array(np.full(size * found, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, kinds)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
