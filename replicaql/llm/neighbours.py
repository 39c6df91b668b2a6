"""Quality classifier (4): similarity-weighted votes of the nearest labelled latent-semantic vectors.

A text becomes counts of word shapes (case, signs at the end, marks), hashed words and repeated words; square-root
frequencies weighted by inverse document frequency are projected on the leading singular vectors of a labelled sample of
at most max_rows rows. The sample's vectors are broadcast (bounded by max_rows x dims), cosines with every text
are exact blocked products, and the k nearest vote by similarity.

Defined results: null, empty and all-space texts score the training rows' share of label 1 (0.5 without any); repeated
rows are separate rows; ties among neighbours go to the earlier rows of the sample, which is in seeded order, and sample rows of equal features
always tie. Extra columns pass through
score_documents(), but for score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_BYTES, crc_mod, labelled, table

MAX_ROWS, DIMS, K = 4_000, 48, 15
SHAPES, HASHED = 1024, 1024
N = SHAPES + HASHED + 4
#: When a text counts as repetitive: this share of words follow themselves; or of more than LONG words so few are distinct. Below SHORT words it is short.
AGAIN, LONG, DISTINCT, SHORT = 0.2, 40, 0.3, 5
MEMO = 400_000


def _kind(word: str) -> int:
    """Packed shape and hash buckets of a word."""
    core = word.rstrip(".,;:?!%&*#$|+=_-~<>()[]{}\"'")
    tail = word[len(core) :]
    case = "u" if core.isupper() else "t" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "x"
    alpha = "a" if core.isalpha() else "n"
    shape = zlib.crc32(f"{case}{alpha}{min(len(core), 1)}{tail}".encode()) % SHAPES
    return shape * HASHED + zlib.crc32(core.lower().encode()) % HASHED


class Features:
    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        out = np.zeros(N, np.float32)
        words = (text or "").split()
        if not words:
            return out
        memo = self.memo
        try:
            packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = _kind(w)
            packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        n = len(words)
        out[:SHAPES] = np.bincount(packed // HASHED, minlength=SHAPES)
        out[SHAPES : SHAPES + HASHED] = np.bincount(packed % HASHED, minlength=HASHED)
        again = int((packed[1:] == packed[:-1]).sum())
        distinct = len(set(words))
        out[SHAPES + HASHED :] = (again, again * (again > AGAIN * n), (n - distinct) * (n > LONG) * (distinct < DISTINCT * n), n * (n < SHORT))
        out /= n
        np.sqrt(out, out=out)
        out[SHAPES : SHAPES + HASHED] *= 0.25
        return out


class Neighbours:
    def __init__(self, texts: list[str], labels: list[int], dims: int = DIMS, k: int = K, seed: int = 3):
        self.k, self.prior = k, float(np.mean(labels)) if labels else 0.5
        f = Features()
        x = np.stack([f.of(t) for t in texts]) if texts else np.zeros((0, N), np.float32)
        self.idf = (np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 1).astype(np.float32)
        x *= self.idf
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((N, min(dims, N))).astype(np.float32)
        for _ in range(6):  # subspace iteration for the leading right singular vectors
            q, _ = np.linalg.qr(x.T @ (x @ q)) if len(x) else (q, None)
        self.basis = q.astype(np.float32)
        places: dict[bytes, int] = {}
        self.place = np.fromiter((places.setdefault(row.tobytes(), len(places)) for row in x), np.int64, len(x))  # of equal rows, one vector
        v = x[np.unique(self.place, return_index=True)[1]] @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        self.vectors = v / np.maximum(norm, 1e-9)
        self.labels = np.array(labels, np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """x: feature rows."""
        v = (x * self.idf) @ self.basis
        norm = np.linalg.norm(v, axis=1)
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        sims = ((v / np.maximum(norm, 1e-9)[:, None]) @ self.vectors.T)[:, self.place]
        k = min(self.k, sims.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        tied = np.flatnonzero((sims >= np.take_along_axis(sims, top, 1).min(1, keepdims=True)).sum(1) > k)
        top[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
        w = np.maximum(np.take_along_axis(sims, top, 1), 0) ** 4
        votes = (w * self.labels[top]).sum(1) / np.maximum(w.sum(1), 1e-9)
        return np.where((norm > 1e-6) & (w.sum(1) > 1e-9), np.clip(votes, 0, 1), out)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = SAMPLE_BYTES, seed: int = 5) -> Neighbours:
    """Fits on a seeded sample of at most max_rows of the given labelled rows, and at most max_bytes of text."""
    rows = labelled(docs, labels, "quality", max_rows, max_bytes, seed)
    return Neighbours([r["text"] for r in rows], [r["quality"] for r in rows])


def score_documents(docs: DataFrame, model: Neighbours) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = np.stack([f.of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(x).astype(float), pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = score_documents(docs, fit(docs, train))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_neighbour_quality": op4_neighbour_quality}
ORACLE_SQL: dict[str, str] = {}
