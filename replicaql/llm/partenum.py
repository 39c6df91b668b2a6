"""N-gram Jaccard join (6): PartEnum signatures over sets of word shingles, exact for a threshold.

Sizes fall into bands whose ends differ by the threshold, so two similar sets lie in one band or in neighbours; each set
signs for both pairs of bands it is in. Within a pair of bands two similar sets differ in at most k shingles. The
shingle domain is dealt by hash to (k+1)/2 groups, of which one holds at most one difference; each group is dealt to
three parts, of which two then agree, and every two of three are a signature. So similar sets share a signature.

Sets (classes of equal sets) that share signatures are compared by exact sizes of intersection and union. No bucket is
turned into all its pairs:

1. a bucket's leader is its class that has most others in its buckets. Every class is compared with one leader, that of
   most of its buckets, and what is similar joins up;
2. buckets whose classes have all joined up are done, and of buckets with the same classes one is kept. Counts of
   shingles by cells (the sum of differences is a lower bound of how far two sets differ) tell which classes outside a
   bucket's largest component can be similar to which others, and those are compared. This is for buckets of at most
   WIDE classes in which it takes at most TESTS tests;
3. in larger ones every class is compared with the leader, if their cells allow it. What is then still open is split by its classes' prefixes (the n - ceil(t n) + 1 smallest hashes, of which similar sets share
   one), and if it is still large every class is compared with the bucket's leader L. Two similar classes differ in
   at most D shingles, so they share one of the D + 1 smallest hashes of what they add to L, or both add at most D;
   then they share one that they lack of L as well, or are both similar to L. Classes that share such a hash are the
   buckets of the next round, without L, until every bucket has joined up.

A pair meets at its leader: the leader's set goes there once for each GROUP members and each member's set once.
A low threshold takes almost as many signatures as shingles. They can be made in passes, each for some of the bands, so that the disks
hold a pass's signatures at a time; cells then go to their buckets in as many passes. Texts stay where they are, but those of rows that share id and text.
Sets are told apart by sums of 64-bit hashes of their shingles (48 bits of each kept for intersections).
Defined results: null, empty and all-space texts have no set and stand alone; repeated rows are copies; a null id stays
null, and has no component_id unless a row of its component has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, written
from .components import components

MEMO = 300_000
GROUP = 2_000  # members that one copy of their leader's set serves
WIDE, TESTS = 20_000, 4_000_000  # classes of a bucket that meet in one task, and tests of their cells there
PARTS = 3
MARK_BYTES = 100  # of a marked row in a broadcast
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashed shingle sets of texts; words' hashes are kept in a bounded memo."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes; a text with fewer words is one shingle, one without words none."""
        import xxhash

        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        try:
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, min(len(h), self.width), np.uint64)
            for i in range(min(self.width, len(h))):
                out = _mix(out * _M1 + h[i : i + n] * _M2 + _M3)
        return np.unique(out)


def bands(most: int, percent: int) -> list[int]:
    """First sizes of the bands: band i ends where percent % of the end reaches its start."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """Smallest hashes of a sorted set, of which any similar set shares one."""
    return s[: len(s) - -(-percent * len(s) // 100) + 1]


def signatures(s: np.ndarray, percent: int, starts: list[int], passes: int = 1, turn: int = 0) -> np.ndarray:
    """64-bit signatures of a non-empty set, for the pair of bands it starts and the pair it ends; of several passes those of one turn."""
    own = int(np.searchsorted(starts, len(s), "right")) - 1
    here = [band for band in {own, max(own - 1, 0)} if band % passes == turn]
    found = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        deal = _mix(s + _M3) if here else s
        for band in here:
            end = starts[band + 2] - 1  # the largest size in this band and the next
            k = (100 - percent) * 2 * end // (100 + percent)
            groups = (k + 2) // 2
            part = (deal % np.uint64(groups * PARTS)).astype(np.int64)
            sums = np.zeros(groups * PARTS, np.uint64)
            order = np.argsort(part, kind="stable")
            sorted_part = part[order]
            first = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]])
            sums[sorted_part[first]] = np.add.reduceat(_mix(s[order] ^ _M1), first)
            sums = _mix(sums + np.arange(groups * PARTS, dtype=np.uint64) * _M2).reshape(groups, PARTS)
            for out in range(PARTS):
                sig = np.full(groups, band * PARTS + out, np.uint64)
                for i in range(PARTS):
                    if i != out:
                        sig = _mix(sig * _M1 + sums[:, i])
                found.append(_mix(sig + np.arange(groups, dtype=np.uint64) * _M3))
    return np.concatenate(found).view(np.int64)


def _key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_mix(np.add.reduce(_mix(s)) + np.uint64(len(s)))) - (1 << 63) if len(s) else 0


def _starts(n: int, cache: dict, percent: int) -> list[int]:
    if "b" not in cache or cache["b"][-3] <= n:
        cache["b"] = bands(10 * n + 1000, percent)
    return cache["b"]


def cells(s: np.ndarray) -> bytes:
    """Counts of shingles by cell, one or two to a cell, each at most 255."""
    m = 1 << (len(s) // 2).bit_length()
    return np.minimum(np.bincount((s >> np.uint64(8)).astype(np.int64) & (m - 1), minlength=m), 255).astype(np.uint8).tobytes()


def _folded(rows: list[bytes]) -> np.ndarray:
    """Cells of several sets, folded to the fewest (they are dealt by the last bits); -1 where a full one says nothing."""
    m = min(map(len, rows))
    out = np.empty((len(rows), m), np.int32)
    for i, raw in enumerate(rows):
        a = np.frombuffer(raw, np.uint8).reshape(-1, m)
        out[i] = np.where((a == 255).any(0), -1, a.sum(0, dtype=np.int32))
    return out


def may_be_similar(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others (folded cells, sizes) may be similar to one."""
    least = np.where((others < 0) | (one < 0), 0, np.abs(others - one)).sum(1)
    return (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & ((100 + percent) * least <= (100 - percent) * (sizes + n))


def sizes(docs: DataFrame, width: int) -> DataFrame:
    """id, t, n (set size), k (the set's hash) and cells of each row of docs (id, text, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(width)
        for b in batches:
            sets = [sh.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()), pa.array([cells(s) for s in sets], pa.binary())], names=["id", "t", "n", "k", "cells"])

    return docs.mapInArrow(run, "id long, t long, n long, k long, cells binary")


def signed(docs: DataFrame, width: int, percent: int, passes: int = 1, turn: int = 0) -> DataFrame:
    """sig, k: each set's signatures, of several passes those of one turn; copies within a task sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, cache, seen = Shingles(width), {}, set()
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                sigs, keys = [], []
                for t in texts[at : at + 500]:
                    s = sh.of(t)
                    k = _key(s)
                    if len(s) and k not in seen:
                        seen.add(k)
                        sigs.append(signatures(s, percent, _starts(len(s), cache, percent), passes, turn))
                        keys.append(np.full(len(sigs[-1]), k, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], names=["sig", "k"])

    return docs.mapInArrow(run, "sig long, k long")


def _packed(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sent(rows: DataFrame, width: int) -> DataFrame:
    """The sets of rows (own, to, text), each to its places (lead, salt, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_packed(sh.of(t)) for t in b.column(2).to_pylist()], pa.binary())], names=["own", "to", "s"])

    kinds = "own long, to array<struct<lead:long,salt:long,kind:int>>, s binary"
    return rows.mapInArrow(run, kinds).select("own", "s", F.explode("to").alias("x")).select("x.lead", "x.salt", "x.kind", "own", "s")


def _split(slim: DataFrame, first: DataFrame, buckets: DataFrame, width: int, percent: int) -> DataFrame:
    """The buckets (g, k) split by the shingles of their classes' prefixes."""
    to = buckets.groupBy("k").agg(F.collect_set("g").alias("to"))  # a class's own signatures
    wanted = written(to.withColumnRenamed("k", "own").join(first, F.col("own") == F.col("k")).select("own", "to", F.col("id").alias("id_"), F.col("t").alias("t_")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen = Shingles(width), set()
        for b in batches:
            for i, own in enumerate(b.column(0).to_pylist()):
                if own not in seen:
                    seen.add(own)
                    to = np.asarray(b.column(1)[i].values).astype(np.int64).view(np.uint64)
                    with np.errstate(over="ignore"):
                        keys = _mix(to[:, None] * _M2 + _prefix(sh.of(b.column(2)[i].as_py()), percent)[None]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), own))], names=["g", "k"])

    return _fetched(slim, wanted, F.lit(40) + 8 * F.size("to")).mapInArrow(run, "g long, k long").distinct()


def _fetched(slim: DataFrame, wanted: DataFrame, row_bytes: Column) -> DataFrame:
    """own, to and text of the wanted rows (own, to, id_, t_)."""
    near = small(wanted, row_bytes)
    return slim.join(near, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))).select("own", "to", "text")


def _compared(slim: DataFrame, first: DataFrame, pairs: DataFrame, width: int, percent: int, all_of: bool) -> DataFrame:
    """Of each pair (lead, k): linked, and where all_of is set the keys by which similar classes meet in the next round.

    slim: id, text, t of all rows; first: k and the id and t of a row that has its set."""
    leads = pairs.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    members = pairs.join(leads, "lead").select(F.col("k").alias("own"), F.struct("lead", F.pmod(F.xxhash64("k"), F.col("salts")).alias("salt"), F.lit(1).alias("kind")).alias("x"))
    heads = leads.select(F.col("lead").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select("own", F.struct(F.col("own").alias("lead"), "salt", F.lit(0).alias("kind")).alias("x"))
    to = members.union(heads).groupBy("own").agg(F.collect_list("x").alias("to"))
    wanted = written(to.join(first, F.col("own") == F.col("k")).select("own", "to", F.col("id").alias("id_"), F.col("t").alias("t_")), "wanted")
    rows = _fetched(slim, wanted, F.lit(40) + 24 * F.size("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, last = None, None, None
        for b in batches:
            out: list[tuple] = []
            keys = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            for i, (name, salt, kind, own) in enumerate(keys):
                if kind == 0:
                    if (name, salt) != at:
                        at, lead, last = (name, salt), _unpack(b.column(4)[i].as_py()), None
                    continue
                if own == last:  # a repeated row of the class
                    continue
                last, s = own, _unpack(b.column(4)[i].as_py())
                added = np.setdiff1d(s, lead, assume_unique=True)
                both = len(s) - len(added)
                linked = 100 * both >= percent * (len(lead) + len(added))
                apart = np.zeros(0, np.uint64)
                if all_of:
                    d = (100 - percent) * (len(s) + len(s) * 100 // percent + 1) // (100 + percent)
                    apart = added[: d + 1]
                    if len(added) <= d:
                        apart = np.concatenate([apart, ~np.setdiff1d(lead, s, assume_unique=True)[: d + 1]])
                    with np.errstate(over="ignore"):
                        apart = _mix(apart * _M1 + np.uint64(name & _ALL))
                out.append((name, own, linked, apart.view(np.int64)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)], names=["lead", "k", "linked", "apart"])

    dealt = _sent(rows, width).repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind", "own")
    return written(dealt.mapInArrow(run, "lead long, k long, linked boolean, apart array<long>"), "compared")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (k, comp) after the links (lead, k)."""
    of = lambda x, y: labels.select(F.col("k").alias(x), F.col("comp").alias(y))
    apart = links.select("lead", "k").join(of("lead", "a"), "lead").join(of("k", "b"), "k").where("a <> b").select("a", "b")
    apart = written(apart.distinct(), "apart")
    if apart.isEmpty():
        return labels
    moved = components(apart)
    return written(labels.join(moved.withColumnRenamed("comp", "to"), labels["comp"] == moved["node"], "left").select("k", F.coalesce("to", "comp").alias("comp")), "labels")


def _led(buckets: DataFrame) -> DataFrame:
    """g, k and the bucket's leader: the class that has most others in its buckets."""
    many = buckets.groupBy("g").agg(F.count("*").alias("size"))
    scores = buckets.join(many, "g").groupBy("k").agg(F.sum("size").alias("score"))
    leads = buckets.join(scores, "k").groupBy("g").agg(F.max(F.struct("score", "k")).alias("x"))
    return buckets.join(leads.select("g", F.col("x.score").alias("score"), F.col("x.k").alias("lead")), "g")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets (g, k, easy) that hold classes of several components; of those with the same classes one."""
    held = buckets.select("g", "k").distinct()
    parts = held.join(labels, "k").groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("all"))
    found = parts.groupBy("g").agg(F.count("*").alias("comps"), F.max("n").alias("most"), F.sum("n").alias("size"), F.sum("all").alias("all")).where("comps > 1")
    one = found.groupBy("size", "all").agg(F.min(F.struct("g", "most")).alias("x"))
    easy = ((F.col("size") - F.col("x.most")) * F.col("size") <= TESTS) & (F.col("size") <= WIDE)
    return written(held.join(one.select("x.g", easy.alias("easy")), "g").select("g", "k", "easy"), "open")


def _possible(buckets: DataFrame, labels: DataFrame, first: DataFrame, percent: int, passes: int) -> DataFrame:
    """Pairs (lead, k) of classes of different components that share a bucket and whose cells allow that they are similar; buckets are dealt to passes."""

    def pairs(held: list[tuple]) -> list[tuple[int, int]]:
        if not held:
            return []
        most = Counter(x[1] for x in held).most_common(1)[0][0]
        held.sort(key=lambda x: x[1] == most)
        keys, comps, sizes = (np.array([x[i] for x in held]) for i in range(3))
        m, out = _folded([x[3] for x in held]), []
        for i in range(int((comps != most).sum())):
            fine = may_be_similar(m[i], sizes[i], m[i + 1 :], sizes[i + 1 :], percent) & (comps[i + 1 :] != comps[i])
            out += [(max(k, keys[i]), min(k, keys[i])) for k in keys[i + 1 :][fine]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["lead", "k"])
        for b in batches:
            for i, (g, k, comp, n) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                if g != at:
                    out += pairs(held)
                    at, held = g, []
                held.append((k, comp, n, b.column(4)[i].as_py()))
            out = list(set(out))
            yield batch()
            out = []
        out += pairs(held)
        yield batch()

    def found(held: DataFrame) -> DataFrame:
        rows = held.select("g", "k").join(labels, "k").join(first.select("k", "n", "cells"), "k").select("g", "k", "comp", "n", "cells")
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "lead long, k long").distinct()

    turns = [written(found(buckets.where(F.pmod("g", F.lit(passes)) == turn)), "possible") for turn in range(passes)]
    return written(reduce(DataFrame.union, turns).distinct(), "pairs") if passes > 1 else turns[0]


def _likely(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, k) whose cells allow that they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, x, n2, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                both = _folded([x, y])
                keep.append(bool(may_be_similar(both[0], n, both[1:], np.array([n2]), percent)[0]))
            yield b.select(["lead", "k"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: first.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
    both = pairs.join(of("lead"), "lead").join(of("k"), "k").select("lead", "k", "n_lead", "cells_lead", "n_k", "cells_k")
    return both.mapInArrow(run, "lead long, k long")


def _labels(slim: DataFrame, first: DataFrame, buckets: DataFrame, width: int, percent: int, passes: int) -> DataFrame:
    """k, comp of the classes in buckets (g, k): comp is the least class that links reach."""
    labels = written(buckets.select("k").distinct().select("k", F.col("k").alias("comp")), "labels")
    best = _led(buckets).where("k <> lead").groupBy("k", "lead").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "lead"))["lead"].alias("lead"))
    best = written(_likely(best.select("lead", "k"), first, percent), "best")
    labels = _joined(labels, _compared(slim, first, best, width, percent, False).where("linked"))
    rounds = 0
    while True:
        buckets = _open(buckets, labels)
        pairs = _possible(buckets.where("easy"), labels, first, percent, passes)
        if not pairs.isEmpty():
            labels = _joined(labels, _compared(slim, first, pairs, width, percent, False).where("linked"))
        large = buckets.where("not easy").select("g", "k")
        if large.isEmpty():
            return labels
        led = written(_likely(_led(large).where("k <> lead").select("lead", "k").distinct(), first, percent), "led")
        if not led.isEmpty():
            labels = _joined(labels, _compared(slim, first, led, width, percent, False).where("linked"))
            large = _open(large, labels)
            # what the leaders have joined up may be easy now
            pairs = _possible(large.where("easy"), labels, first, percent, passes)
            if not pairs.isEmpty():
                labels = _joined(labels, _compared(slim, first, pairs, width, percent, False).where("linked"))
            large = large.where("not easy").select("g", "k")
            if large.isEmpty():
                return labels
        if not rounds:
            buckets = written(_split(slim, first, large, width, percent), "buckets")
        else:
            found = _compared(slim, first, _led(large).where("k <> lead").select("lead", "k").distinct(), width, percent, True)
            labels = _joined(labels, found.where("linked"))
            buckets = found.select(F.explode("apart").alias("g"), "k")
        rounds += 1


def _classes(docs: DataFrame, id_col: str, width: int, percent: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, t: hash of the text, n, k), and of each class k_: nameless, the component's least id and its first row, and the class's last row."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), "text", F.xxhash64("text").alias("t"))
    sized = written(sizes(slim, width), "sizes")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")  # rows without an id come last
    classes = sized.where("n > 0").groupBy("k").agg(F.min("id").alias("rep"), F.max(F.col("id").isNull()).alias("nameless"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.min(row).alias("first"), F.max(row).alias("last"))
    bucket = W.partitionBy("sig")

    def met(turn: int) -> DataFrame:
        shared = signed(slim, width, percent, passes, turn).withColumn("lo", F.min("k").over(bucket)).withColumn("hi", F.max("k").over(bucket))
        return written(shared.where("lo < hi").select(F.col("sig").alias("g"), "k").distinct(), "shared")

    shared = reduce(DataFrame.union, [met(turn) for turn in range(passes)])  # a signature is made in one pass only
    first = written(shared.select("k").distinct().join(classes, "k").select("k", "n", "cells", "rep", "first"), "members")
    labels = _labels(slim, first.select("k", "n", "cells", "first.id", "first.t"), shared, width, percent, passes)
    named = first.join(labels, "k")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"), F.min("first").alias("whole"))
    named = named.join(least, "comp").select("k", "least", "whole")
    return sized, classes.join(named, "k", "left").select(F.col("k").alias("k_"), F.coalesce("least", "rep").alias("least"), "nameless", F.coalesce("whole", "first").alias("first"), "last")


def join_components(docs: DataFrame, id_col: str = "doc_id", width: int = 3, percent: int = 90, passes: int = 1) -> DataFrame:
    """id, k (class), n (set size) and component_id: the smallest id reachable by links of similar sets."""
    sized, classes = _classes(docs, id_col, width, percent, passes)
    # only classes that move an id: most rows are alone
    moved = classes.join(sized.where("n > 0").groupBy(F.col("k").alias("k_")).agg(F.max("id").alias("most")), "k_").where("most <> least or nameless and least is not null").select("k_", "least")
    out = sized.join(moved, sized["k"] == moved["k_"], "left")
    return out.select("id", "k", "n", F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", width: int = 5, percent: int = 80, passes: int = 2) -> DataFrame:
    """One document of each component: that of the smallest id, and of texts with that id the one of smallest hash; of rows that
    share both, the one whose other columns (but maps) have the smallest hash, so that reruns agree."""
    sized, classes = _classes(docs, id_col, width, percent, passes)
    several = classes.where(F.col("first") != F.col("last")).select("k_", "first")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    drop = sized.where("n > 0").join(several, F.col("k") == F.col("k_")).where(~stays)
    several_rows = sized.groupBy("id", "t").agg(F.count("*").alias("rows")).where("rows > 1")  # other rows need not meet
    marks = drop.select("id", "t", F.lit(True).alias("gone")).union(several_rows.select("id", "t", F.lit(False)))
    marks = written(marks.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.max("gone").alias("_gone")), "marks")
    kept = docs.join(small(marks, F.lit(MARK_BYTES)), docs[id_col].eqNullSafe(marks["_id"]) & (F.xxhash64(docs["text"]) == marks["_t"]), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    alone = kept.where("_gone is null").select(*own)
    if marks.where("not _gone").isEmpty():
        return alone
    kept = kept.where("not _gone").select(*own)
    rest = [c for c in docs.columns if c not in (id_col, "text")]
    order = F.xxhash64(*[F.col(f"`{c}`") for c in rest if "map<" not in docs.schema[c].dataType.simpleString()])
    one = kept.groupBy(id_col, "text").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_rest")) if rest else kept.distinct()
    return alone.union(one.select(*[F.col(f"`{c}`") if c in (id_col, "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]))


def op6_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


QUERIES = {"op6_partenum": op6_partenum}
ORACLE_SQL: dict[str, str] = {}
