"""Embedding near-duplicates (11): collision-counting projections.

Every vector is projected on M random directions, and a pair collides in a direction if the other vector lies within a window
centred on the query. For vectors at the threshold a projected difference is normal with a known spread, so the window
is calibrated: the pair counts as found if it collides in M - MISSES directions at least, and a pair at the threshold itself misses that with
probability 1 - RECALL at most (pairs above it with less). Found pairs are verified by their cosine in double precision.

Counts are never made from all collisions of one direction, which would be a fixed share of all pairs. The directions form
MISSES + 1 groups: a pair with at most MISSES misses collides in all directions of one group, so sorting into cells of a group's
first directions finds every pair that can pass. A vector lies in its own cell (home) and visits those that its window reaches,
forward only in the first direction, so each pair meets once a group; the first group in which it collides throughout
counts it. Cells with many vectors are dealt by blocks, each block of homes with each block of visitors. Tasks give
counts and a spanning set of links, never pairs: a group of near copies costs time by pairs, but no rows.

Copies of a vector are one class with a weight, by comparison of all components.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label or id,
link with nothing: 0 links and a component of their own (null for a null id). Vectors of different lengths don't link. Rows that repeat an id
are vectors of their own; a component's id is the smallest of its rows, so ties need no rule. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written
from .components import components

M, MISSES, RECALL = 24, 1, 0.99999
#: Vectors of a cell that one task compares with as many; directions that a cell may use; units of a projection.
BLOCK, DEPTH, UNIT = 2_048, 4, 1 << 20
#: Pairs verified at once.
PAIRS = 32_768


def window(cosine: float, dim: int, m: int = M, misses: int = MISSES, recall: float = RECALL) -> float:
    """Half the window's width, for which a pair of unit vectors with that cosine has more than misses misses with probability 1 - recall."""
    lo, hi = 0.0, 1.0  # the chance of a miss in one direction
    for _ in range(100):
        p = (lo + hi) / 2
        fine = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(misses + 1))
        lo, hi = (p, hi) if fine > recall else (lo, p)
    return -NormalDist().inv_cdf(lo / 2) * math.sqrt((2 - 2 * cosine) / dim)


def directions(dim: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m)) / math.sqrt(dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def classes(df: DataFrame, m: int = M) -> DataFrame:
    """df: id, label, v. Returns cls, label, v, dim, w (rows), least (id) and proj (in units), one row for each label and vector; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(2))
            proj = np.zeros((len(b), m), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = np.asarray(b.column(1).take(pa.array(at)).flatten()).reshape(len(at), dim)
                proj[at] = np.rint(_unit(v) @ directions(int(dim), m) * UNIT)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(proj), pa.list_(pa.int64()))], names=[*b.schema.names, "proj"])

    each = df.groupBy("label", "v").agg(F.count("*").alias("w"), F.min("id").alias("least")).select("label", "v", F.size("v").alias("dim"), "w", "least")
    kinds = f"label {df.schema['label'].dataType.simpleString()}, v array<double>, dim int, w long, least long, proj array<long>"
    return written(each.mapInArrow(run, kinds).withColumn("cls", F.monotonically_increasing_id()), "classes")


def _cells(group: int, size: int, depth: int, width: Column, home: bool) -> Column:
    """The cells of a class in a group of directions: its own, or those that its window reaches (cells are twice as wide)."""
    cell = lambda x: F.floor(x / (2 * width)).cast("long")
    found = F.array(F.concat_ws("|", "dim", "label", F.lit(str(group))))
    for d in range(depth):
        a = F.col("proj")[group * size + d]
        reach = F.array(cell(a)) if home else F.sequence(cell(a if d == 0 else a - width), cell(a + width))
        found = _joined(found, reach)
    return found


def _joined(names: Column, more: Column) -> Column:
    return F.flatten(F.transform(names, lambda x: F.transform(more, lambda y: F.concat_ws("|", x, y))))


def _placed(cells: Column, home: bool, group: int) -> Column:
    return F.transform(cells, lambda c: F.struct(c.alias("cell"), F.lit(home).alias("home"), F.lit(group).alias("grp")))


def meetings(held: DataFrame, widths: Column, m: int, misses: int, depth: int) -> DataFrame:
    """cell, home and cls of every class: where it lives and where it visits, in each group of directions."""
    size = m // (misses + 1)
    roles = [_placed(_cells(g, size, depth, widths, home), home, g) for g in range(misses + 1) for home in (True, False)]
    return held.select("*", F.explode(F.flatten(F.array(*roles))).alias("x")).select("cls", "w", "v", "proj", "dim", "x.*")


def linked(held: DataFrame, percent: float = 98.0, m: int = M, misses: int = MISSES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """a, b, n: rows of other classes that class a links with (b null), in parts, and links that span the components (n null)."""
    cosine, size = percent / 100, m // (misses + 1)
    if m % (misses + 1):
        raise ValueError("directions must divide into misses + 1 groups")
    most = held.groupBy("dim", "label").count().agg(F.max("count")).first()[0] or 0
    depth = min(DEPTH, size, max(1, math.ceil(math.log(max(most, 1) / block, 2.5))))
    # the window of each length, in units
    spread = window(cosine, 1, m, misses, recall)
    widths = F.ceil(F.lit(spread * UNIT) / F.sqrt("dim")) + 1

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        dim, group = t.column("dim")[0].as_py(), t.column("grp")[0].as_py()
        own = np.asarray(t.column("home"))
        ids, w = np.asarray(t.column("cls")), np.asarray(t.column("w"))
        u = _unit(np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(ids), dim))
        p = np.asarray(t.column("proj").combine_chunks().flatten()).reshape(len(ids), m)
        half = math.ceil(spread * UNIT / math.sqrt(dim)) + 1
        at = np.flatnonzero(own)
        at = at[np.lexsort((ids[at], p[at, group * size]))]  # sorted by the group's first projection
        line, guests = p[at, group * size], np.flatnonzero(~own)
        counts, parent = np.zeros(len(ids), np.int64), {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        def verify(q: np.ndarray, o: np.ndarray) -> None:
            near = np.abs(p[q] - p[o]) <= half
            fine = near.sum(1) >= m - misses
            for g in range(group):  # a pair that an earlier group finds is counted there
                fine &= ~near[:, g * size : (g + 1) * size].all(1)
            q, o = q[fine], o[fine]
            close = np.einsum("ij,ij->i", u[q], u[o]) >= cosine
            q, o = q[close], o[close]
            np.add.at(counts, q, w[o])
            np.add.at(counts, o, w[q])
            for i, j in {*zip(ids[q].tolist(), ids[o].tolist(), strict=True)}:
                i, j = find(i), find(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)

        lo = np.searchsorted(line, p[guests, group * size], "left")
        hi = np.searchsorted(line, p[guests, group * size] + half, "right")
        left_q, left_o, held_back = [], [], 0
        for q, a, z in zip(guests.tolist(), lo.tolist(), hi.tolist(), strict=True):
            o = at[a:z]
            for d in range(1, size):  # the window's other directions, fewer rows each
                if not len(o):
                    break
                o = o[np.abs(p[o, group * size + d] - p[q, group * size + d]) <= half]
            o = o[(p[o, group * size] > p[q, group * size]) | (ids[o] > ids[q])]
            left_q.append(np.full(len(o), q))
            left_o.append(o)
            held_back += len(o)
            if held_back >= PAIRS:
                verify(np.concatenate(left_q), np.concatenate(left_o))
                left_q, left_o, held_back = [], [], 0
        if held_back:
            verify(np.concatenate(left_q), np.concatenate(left_o))
        some = np.flatnonzero(counts)
        links = [(i, r) for i in parent if (r := find(i)) != i]
        n = len(links)
        return pa.table({
            "a": pa.concat_arrays([pa.array(ids[some]), pa.array([i for i, _ in links], pa.int64())]), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array([r for _, r in links], pa.int64())]),
            "n": pa.concat_arrays([pa.array(counts[some]), pa.nulls(n, pa.int64())]),
        })

    met = meetings(held, widths, m, misses, depth)
    full = written(met.groupBy("cell", "home").agg(F.count("*").alias("rows")).where(F.col("rows") > block), "full")
    parts = full.groupBy("cell").agg(*[F.coalesce(F.max(F.when(F.col("home") == h, F.ceil(F.col("rows") / block))), F.lit(1)).cast("int").alias(name) for h, name in ((True, "homes"), (False, "guests"))])
    met = met.join(small(parts, F.lit(24) + F.octet_length("cell")), "cell", "left").na.fill(1, ["homes", "guests"])
    share = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    mine, others = F.when(F.col("home"), share("homes")).otherwise(share("guests")), F.when(F.col("home"), F.col("guests")).otherwise(F.col("homes"))
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    met = met.withColumn("i", F.when(F.col("home"), F.col("mine")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("home"), F.col("other")).otherwise(F.col("mine")))
    return met.select("cell", "i", "j", "cls", "w", "v", "proj", "dim", "home", "grp").groupBy("cell", "i", "j").applyInArrow(meet, "a long, b long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", percent: float = 98.0, **options) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"), (fine & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).alias("fine"))
    rows = written(rows, "vectors")
    held = classes(rows.where("fine").select("id", "label", "v"))
    found = written(linked(held, percent, **options), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    known = held.select("cls", "label", "v", "w", "least").join(counts, "cls", "left").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    known = written(known.select("comp", "label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "known")
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(least, "comp").select("label", "v", "n_links", "component_id")
    named = rows.where("fine").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    return named.union(rows.where("not fine").select("id", F.lit(0).cast("long"), "id")).withColumn("kept", F.col("id") == F.col("component_id"))


def op11_collision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op11_collision_links": op11_collision_links}
ORACLE_SQL: dict[str, str] = {}
