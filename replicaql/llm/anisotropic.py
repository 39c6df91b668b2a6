"""Approximate nearest neighbours (2): score-aware anisotropic product quantisation with four-bit tables.

Codebooks of 16 words for each pair of dimensions are fitted on at most SAMPLE vectors (seeded) under a loss that counts
the part of the residual parallel to the vector eta times: that part moves the largest inner products. A squared distance is
|q|^2 - 2 q.x + |x|^2, so inner products give Euclidean order with the exact |x|^2 stored. Every vector is coded (two
codes a byte) and written in blocks. Queries go over all blocks in chunks of at most CHUNK (the broadcast's bound): table
lookups give approximate distances, the best rerank of each block are computed exactly in double precision, and then every
vector whose distance may still be among the k best: a query is at least as far from a vector as from its code, less the
code's own error. Where these are many (copies of a query), a matrix product with a bound on its rounding drops most
first. Each task keeps the k best it has seen, so results equal brute force.

Defined results: vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite
components take no part, nor do null ids; a query never finds its own row, but rows that repeat its id; each row of a
repeated query id is a query; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SAMPLE, CHUNK, RERANK, ETA = 8_000, 8_000, 48, 4.0
#: Above this share of a block's pairs a matrix product comes before exact distances, of which so many components are made at once.
MANY, PAIRS = 0.02, 4_000_000


class Quantiser:
    def __init__(self, x: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = 1):
        self.dim, self.eta = x.shape[1], eta
        self.m = (self.dim + 1) // 2
        self.pad = 2 * self.m - self.dim
        s, u = self._split(x)
        rng = np.random.default_rng(seed)
        pick = rng.integers(0, len(x), 16)
        self.books = np.stack([s[pick, j] + 1e-3 * rng.standard_normal((16, 2)) for j in range(self.m)]).astype(np.float32)
        for _ in range(rounds):
            codes = self._codes(s, u)
            for j in range(self.m):
                left = self._parallel(s, u, codes) - self._part(s, u, codes, j)
                for c in range(16):
                    rows = np.flatnonzero(codes[:, j] == c)
                    if not len(rows):
                        continue
                    v, w = s[rows, j].astype(float), u[rows, j].astype(float)
                    a = len(rows) * np.eye(2) + (eta - 1) * w.T @ w
                    b = v.sum(0) + (eta - 1) * (w * (left[rows] + (w * v).sum(1))[:, None]).sum(0)
                    self.books[j, c] = np.linalg.solve(a, b)

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.pad(x.astype(np.float32), ((0, 0), (0, self.pad)))
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)  # what is far smaller than the largest is 0 in single precision
        return x.reshape(len(x), self.m, 2), u.reshape(len(x), self.m, 2)

    def _part(self, s, u, codes, j) -> np.ndarray:
        return (u[:, j] * (s[:, j] - self.books[j][codes[:, j]])).sum(1)

    def _parallel(self, s, u, codes) -> np.ndarray:
        return sum(self._part(s, u, codes, j) for j in range(self.m))

    def _codes(self, s: np.ndarray, u: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent on the loss |r|^2 + (eta - 1) (r parallel)^2."""
        near = [((s[:, j, None] - self.books[j][None]) ** 2).sum(2) for j in range(self.m)]
        codes = np.stack([d.argmin(1) for d in near], 1)
        total = self._parallel(s, u, codes)
        for _ in range(sweeps):
            for j in range(self.m):
                left = total - self._part(s, u, codes, j)
                along = (u[:, j, None] * (s[:, j, None] - self.books[j][None])).sum(2)
                codes[:, j] = (near[j] + (self.eta - 1) * (left[:, None] + along) ** 2).argmin(1)
                total = left + self._part(s, u, codes, j)
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Four-bit codes, two a byte."""
        codes = self._codes(*self._split(x)).astype(np.uint8)
        if self.m % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each code word: (m, 16, queries)."""
        q = np.pad(q.astype(np.float32), ((0, 0), (0, self.pad))).reshape(len(q), self.m, 2)
        return np.ascontiguousarray(np.einsum("qmd,mcd->mcq", q, self.books))

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, : self.m]
        return self.books[np.arange(self.m), codes].reshape(len(packed), -1)[:, : self.dim].astype(float)

    def products(self, tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (vectors, queries)."""
        out = np.zeros((len(packed), tables.shape[2]), np.float32)
        for j in range(self.m):
            code = packed[:, j // 2] >> 4 if j % 2 == 0 else packed[:, j // 2] & 15
            out += tables[j][code]
        return out


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows; one code for all of them, so that equal pairs are equally far apart to the last bit."""
    d = np.ascontiguousarray(a - b)
    return np.sqrt((d * d).sum(1))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), dim)


def build(rows: DataFrame, dim: int, sample: int = SAMPLE) -> tuple[Quantiser, DataFrame]:
    """The quantiser and the written index of all rows: id, row, v (scaled so that the largest component is about 1) and code."""
    spark = rows.sparkSession
    chosen = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "row").limit(sample).toArrow()
    quant = Quantiser(_matrix(chosen.column("v").combine_chunks(), dim))
    held = spark.sparkContext.broadcast(quant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = held.value.encode(_matrix(b.column(2), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "row", "v", "code"])

    return quant, written(rows.select("id", "row", "v").mapInArrow(run, "id long, row long, v array<double>, code binary"), "index")


def _merge(d: np.ndarray, w: np.ndarray, more_d: np.ndarray, more_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of both of each row, by distance and then id, as many as d has."""
    k = d.shape[1]
    d, w = np.concatenate([d, more_d], 1), np.concatenate([w, more_w], 1)
    order = np.lexsort((w, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)


def _rest(may: np.ndarray, v: np.ndarray, vec_ids: np.ndarray, q: np.ndarray, best: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best and names with the exact distances of the (query, vector) pairs that may name."""
    if may.mean() > MANY:
        size = (q * q).sum(1)[:, None] + (v * v).sum(1)
        may &= size - 2 * q @ v.T - 1e-12 * len(v.T) * size <= best[:, -1:] ** 2
    who, which = np.nonzero(may)
    step = max(1, PAIRS // v.shape[1])
    for lo in range(0, len(who), step):
        row, at = who[lo : lo + step], which[lo : lo + step]
        d, w = _apart(v[at], q[row]), vec_ids[at]
        fine = d <= best[row, -1]
        row, d, w = row[fine], d[fine], w[fine]
        order = np.lexsort((w, d, row))
        row, d, w = row[order], d[order], w[order]
        hit, first = np.unique(row, return_index=True)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = place < best.shape[1]
        more_d, more_w = np.full((len(hit), best.shape[1]), np.inf), np.full((len(hit), best.shape[1]), np.iinfo(np.int64).max)
        line = np.searchsorted(hit, row[kept])
        more_d[line, place[kept]], more_w[line, place[kept]] = d[kept], w[kept]
        best[hit], names[hit] = _merge(best[hit], names[hit], more_d, more_w)
    return best, names


def search(quant: Quantiser, index: DataFrame, ids: np.ndarray, own_rows: np.ndarray, q: np.ndarray, k: int, rerank: int) -> DataFrame:
    """query_id, query_row, vec_id, score: the k nearest that each task found for one chunk of queries."""
    held = index.sparkSession.sparkContext.broadcast((quant, ids, own_rows, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quant, ids, own_rows, q = held.value
        tables, n = quant.tables(q), len(ids)
        best = np.full((n, k), np.inf)
        names = np.full((n, k), np.iinfo(np.int64).max)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                vec_ids, rows, v = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), q.shape[1])
                packed = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(v), -1)
                coded = quant.decode(packed)
                error = np.sqrt(((v - coded) ** 2).sum(1))
                squares, own = (v * v).sum(1).astype(np.float32), (coded * coded).sum(1)
                for lo in range(0, n, 512):
                    hi = min(lo + 512, n)
                    both = quant.products(tables[:, :, lo:hi], packed)
                    far = squares[:, None] - 2 * both
                    itself = rows[:, None] == own_rows[None, lo:hi]
                    far[itself] = np.inf
                    top = min(rerank, len(v))
                    at_rows = np.argpartition(far, top - 1, axis=0)[:top].T if top < len(v) else np.tile(np.arange(len(v)), (hi - lo, 1))
                    exact = _apart(v[at_rows.ravel()], np.repeat(q[lo:hi], top, 0)).reshape(hi - lo, top)
                    found = vec_ids[at_rows]
                    exact[rows[at_rows] == own_rows[lo:hi, None]] = np.inf
                    best[lo:hi], names[lo:hi] = _merge(best[lo:hi], names[lo:hi], exact, found)
                    if top < len(v):
                        # sums of m lookups in single precision: their rounding is allowed for
                        size = own + (q[lo:hi] ** 2).sum(1)[:, None]
                        least = np.sqrt(np.maximum(size - 2 * both.T - 1e-6 * quant.m * size, 0)) - error
                        may = ~(least > best[lo:hi, -1:] * (1 + 1e-9))
                        np.put_along_axis(may, at_rows, False, 1)
                        may &= ~itself.T
                        best[lo:hi], names[lo:hi] = _rest(may, v, vec_ids, q[lo:hi], best[lo:hi], names[lo:hi])
        keep = np.isfinite(best)
        who, whose = (np.repeat(x, k).reshape(n, k)[keep] for x in (ids, own_rows))
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(whose), pa.array(names[keep]), pa.array(best[keep])], names=["query_id", "query_row", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, query_row long, vec_id long, score double")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """The k nearest of each row whose id is divisible by every."""
    spark = df.sparkSession
    kinds = "query_id long, rank int, vec_id long, score double"
    rows = written(valid(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], kinds)
    rows = rows.where(F.size("v") == common["dim"])
    # all in units of a power of two, which rounds nothing: neither squares nor single precision overflow
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    unit = 2.0 ** math.frexp(largest)[1] if largest < 2.0**1023 else 2.0**1023
    rows = rows.withColumn("v", F.transform("v", lambda x: x / unit))
    quant, index = build(rows, common["dim"])
    asked = rows.where(F.col("id") % every == 0)
    chunks = max(1, -(-asked.count() // CHUNK))
    found = None
    for c in range(chunks):  # a chunk is at most about CHUNK queries: the bound of what is collected and broadcast
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).toArrow()
        if not part.num_rows:
            continue
        got = search(quant, index, np.asarray(part.column("id")), np.asarray(part.column("row")), _matrix(part.column("v").combine_chunks(), common["dim"]), k, rerank)
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], kinds)
    place = W.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") * unit).alias("score"))


def op2_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_anisotropic": op2_anisotropic}
ORACLE_SQL: dict[str, str] = {}
