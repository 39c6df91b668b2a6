"""LM scoring (1): a Katz backoff bigram model, counted on training rows and scored over all rows.

P(w | h) is d(r) r / c(h) for bigrams counted r times (d: Good-Turing discounts up to r = 5) and alpha(h) P(w) for others;
alpha(h) = (1 - seen discounted mass) / (1 - P of the words seen after h), so each context sums to 1 exactly. P(w) is
discounted in the same way and leaves its rest to the class of unseen words. A context all of whose counts stand
undiscounted (and likewise the words, if none is) has no mass left: its unseen words are counted once, so that it sums
to 1 as well.

Texts are held in blocks of about BLOCK tokens: word hashes, and tokens as places among them. Blocks send their distinct
words and bigrams, with counts, to buckets whose number grows with the corpus, and name a word or context once a message; buckets merge counts and write the tables
(one row of packed columns a bucket), and answer each block in the order in which it asked: with counts of bigrams, and with
the sum and the backoff weight of each whole context. Bigrams are dealt by context, so a
bucket holds whole contexts; contexts with at least a ten-thousandth of all tokens (so at most 10,001 with the text's
start) are dealt by word over as many parts as hold a quarter of a bucket each, and only their sums are collected and
broadcast. No word or bigram is sent twice by a block,
so common ones weigh no more than rare ones.

Words are told apart by 64-bit hashes. Their buckets are ranges of hashes, so a word's bucket and its place there make a
number for it in the same order; bigrams are sent as such numbers.
Defined results: a null text is empty and has one token, its end; rows are separate even if repeated; null ids train;
without training tokens scores use the unseen class alone; an empty table gives an empty result.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, crc_mod, small_batches, table, written

BLOCK = 1_500_000
BUCKET = 2_500_000  # tokens for each bucket
HOT = 10_000
TOP = 5  # counts up to TOP are discounted
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    import zstandard

    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str[1:].encode(), len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind = np.dtype("<" + raw[at : at + 2].decode())
        n = int.from_bytes(raw[at + 2 : at + 10], "little")
        at += 10
        size = n * kind.itemsize
        out.append(np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, held, text -> block, n, ids, held, data (lengths, word hashes, training counts, tokens)."""
    import xxhash

    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list[bool] = []
    lengths: list[int] = []
    places: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    n = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, held, lengths, places, parts, n, number
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in places), np.uint64, len(places))
        tokens = np.concatenate(parts)
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # common words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[tokens]
        trains = np.repeat(~np.array(held), lengths)
        counts = np.bincount(tokens[trains], minlength=len(order)).astype(np.uint32)
        data = _pack(np.array(lengths, np.uint32), hashes[order], counts, tokens)
        row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([n]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([data], pa.binary())], names=["block", "n", "ids", "held", "data"])
        ids, held, lengths, places, parts, n, number = [], [], [], {}, [], 0, number + 1
        return row

    for b in batches:
        for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (text or "").encode().lower().split()
            words.append(b"")  # the end
            for w in set(words):
                if w not in places:
                    places[w] = len(places)
            parts.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            ids.append(i)
            held.append(h)
            lengths.append(len(words))
            n += len(words)
            if n >= BLOCK:
                yield flush()
    if ids:
        yield flush()


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's lengths, and hashes, counts and tokens with words in the order of their hashes."""
    lengths, hashes, counts, tokens = _unpack(data)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return lengths, hashes[order], counts[order], place[tokens]


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets' ranges in sorted hashes."""
    step = (1 << 64) // buckets
    return np.searchsorted(hashes, np.array([step * (i + 1) for i in range(buckets - 1)] + [(1 << 64) - 1], np.uint64), "right")


def discounts(of: np.ndarray) -> np.ndarray:
    """d(0..TOP) from numbers of items with counts 1..TOP+1 (Katz's form of Good-Turing; 1 where they don't allow it)."""
    d = np.ones(TOP + 1)
    n = np.r_[0.0, of]
    if n[1] > 0:
        cut = (TOP + 1) * n[TOP + 1] / n[1]
        for r in range(1, TOP + 1):
            if n[r] > 0 and n[r + 1] > 0 and cut < 1:
                v = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
                d[r] = v if 0.05 < v < 1 else 1.0
        d[1] = min(d[1], 0.95)  # some mass is always left to unseen items
    return d


def _small(counts: np.ndarray) -> np.ndarray:
    """Numbers of items with counts 1..TOP+1."""
    return np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].astype(np.int64)


def _merge_words(group: pa.Table) -> pa.Table:
    """One bucket's words: the table row (block -1: hashes, places, counts) and each block's answer: places and counts."""
    bucket = group.column("bucket")[0].as_py()
    sent = [_unpack(x.as_py()) for x in group.column("data")]
    words, place = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([s[1] for s in sent]), len(words)).astype(np.int64)
    answers = np.split(place, np.cumsum([len(s[0]) for s in sent])[:-1])
    seen = counts > 0
    rows = [_pack(words[seen], np.flatnonzero(seen), counts[seen]), *(_pack(np.diff(a, prepend=0).astype(np.uint32), counts[a]) for a in answers)]
    zero = [0] * len(sent)
    small = [_small(counts[seen]).tolist()] + [None] * len(sent)
    return pa.table({"block": pa.array([-1, *group.column("block").to_pylist()], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "total": pa.array([int(counts.sum()), *zero], pa.int64()), "types": pa.array([int(seen.sum()), *zero], pa.int64()), "words": pa.array([len(words), *zero], pa.int64()), "small": pa.array(small, pa.list_(pa.int64())), "data": pa.array(rows, pa.binary())})


class Unigrams:
    """P(w) of training words, and of the class of all others. Where the discounts leave that class nothing, it is
    counted once."""

    def __init__(self, total: int, types: int, small: list[int]):
        self.total, self.types = total, types
        self.d = discounts(np.array(small, float))
        lost = sum(r * small[r - 1] * (1 - self.d[r]) for r in range(1, TOP + 1))
        self.mass = total + (lost <= 0)
        self.unseen = (lost if lost > 0 else 1.0) / self.mass

    def p(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(float)
        d = self.d[np.minimum(counts, TOP).astype(int)]
        d = np.where(counts > TOP, 1.0, d)
        return np.where(counts > 0, d * counts / self.mass, self.unseen)


def _gaps(at: np.ndarray, first: np.ndarray, wide: type) -> np.ndarray:
    """at, which rises within each context, as steps; each context starts anew."""
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    return steps.astype(wide)


def _risen(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Undoes _gaps: running sums that start anew with each context."""
    total = np.cumsum(steps, dtype=np.int64)
    start = np.r_[0, np.cumsum(sizes, dtype=np.int64)[:-1]]
    return total - np.repeat(total[start] - steps[start], sizes)


class _Bigrams:
    """The distinct bigrams of a block in the order in which they are sent: by bucket, then by numbers of context and word."""

    def __init__(self, data: bytes, numbers: np.ndarray, words: np.ndarray, uni: Unigrams, buckets: int):
        lengths, _, _, self.tokens = _opened(data)
        self.lengths, n = lengths.astype(np.int64), len(words)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        keys = np.empty(len(self.tokens), np.int64)
        keys[1:] = self.tokens[:-1]
        keys[self.starts] = n  # the text's start
        keys *= n + 1
        keys += self.tokens
        keys, place = np.unique(keys, return_inverse=True)  # words are in the order of their numbers, so bigrams are too
        self.place = place.astype(np.uint32)
        self.context, self.word = (keys // (n + 1)).astype(np.uint32), (keys % (n + 1)).astype(np.uint32)
        del keys, place
        self.numbers = numbers
        shares = np.r_[words * (4 * buckets) // max(uni.total, 1), 4 * buckets].astype(np.uint64)  # in quarters of a bucket
        self.hot = np.r_[words * HOT >= uni.total, True] & (shares > 0)
        with np.errstate(over="ignore"):
            spread, seed = _mix(numbers), _mix(numbers * _M2 + np.uint64(1))
        salt = np.where(self.hot[self.context], seed[self.word] % (shares[self.context] + np.uint64(1)), np.uint64(0))
        bucket = _mix(_mix(salt) ^ spread[self.context]) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.ends = np.searchsorted(bucket[self.order], np.arange(buckets, dtype=np.uint64), "right")

    def payloads(self, held: list[bool], words: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """To each bucket its contexts and words, once each, and its bigrams as places among the words."""
        counts = np.bincount(self.place[np.repeat(~np.array(held), self.lengths)], minlength=len(self.context)).astype(np.uint32)
        wide = np.uint32 if words.max(initial=0) < 1 << 32 else np.uint64
        for bucket, rows in enumerate(np.split(self.order, self.ends[:-1])):
            if len(rows):
                context = self.context[rows]
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                sizes = np.diff(np.r_[first, len(rows)]).astype(np.uint32)
                own, at = np.unique(self.word[rows], return_inverse=True)
                names = context[first]
                yield bucket, _pack(np.diff(self.numbers[names], prepend=np.uint64(0)), sizes, self.hot[names].astype(np.uint8), np.diff(self.numbers[own], prepend=np.uint64(0)), words[own].astype(wide), _gaps(at, first, np.uint16 if len(own) < 1 << 16 else np.uint32), counts[rows])


def _merge_pairs(group: pa.Table) -> pa.Table:
    """One bucket's bigrams: contexts, words with their counts, and distinct bigrams with counts; who asked for which."""
    bucket = group.column("bucket")[0].as_py()
    sent = [_unpack(x.as_py()) for x in group.column("data")]
    contexts, c = np.unique(np.concatenate([np.cumsum(s[0]) for s in sent]), return_inverse=True)
    words, w = np.unique(np.concatenate([np.cumsum(s[3]) for s in sent]), return_inverse=True)
    hot, word_counts = np.zeros(len(contexts), np.uint8), np.zeros(len(words), np.int64)
    hot[c] = np.concatenate([s[2] for s in sent])
    word_counts[w] = np.concatenate([s[4] for s in sent])
    c, w = (np.split(x, np.cumsum([len(s[k]) for s in sent])[:-1]) for x, k in ((c, 0), (w, 3)))
    keys = np.concatenate([np.repeat(ci, s[1]) * len(words) + wi[_risen(s[5], s[1])] for s, ci, wi in zip(sent, c, w, strict=True)])
    ends, counts = np.cumsum([len(s[6]) for s in sent]), np.concatenate([s[6] for s in sent])
    del sent, c, w
    # in the order in which blocks ask: of context and word
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, counts, len(keys)).astype(np.int64)
    asked = _pack(*[np.diff(p, prepend=0).astype(np.uint32) for p in np.split(place, ends[:-1])])
    del place
    at, word = keys // len(words), keys % len(words)
    del keys
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[first, len(at)]).astype(np.uint32)
    bigrams = _pack(np.diff(contexts, prepend=np.uint64(0)), sizes, hot, np.diff(words, prepend=np.uint64(0)), word_counts, _gaps(word, first, np.uint32), counts)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "small": pa.array([_small(counts[counts > 0]).tolist()], pa.list_(pa.int64())), "bigrams": pa.array([bigrams], pa.binary()), "blocks": pa.array([group.column("block").to_pylist()], pa.list_(pa.int64())), "asked": pa.array([asked], pa.binary())})


def _table(raw: bytes, uni: Unigrams) -> tuple[np.ndarray, ...]:
    """A bucket's contexts and whether they are hot; its bigrams' places among them, counts, and P of their words."""
    gaps, sizes, hot, _, word_counts, steps, counts = _unpack(raw)
    return np.cumsum(gaps), hot, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), counts, uni.p(word_counts)[_risen(steps, sizes)]


def _sums(contexts, at, counts, p, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: its count, what discounts take from it, and P of the words seen after it."""
    lost = np.where(counts > TOP, 0.0, 1 - d[np.minimum(counts, TOP)]) * counts
    n = len(contexts)
    return np.bincount(at, counts, n), np.bincount(at, lost, n), np.bincount(at, np.where(counts > 0, p, 0), n)


def _weights(c, lost, seen, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: what its counts are divided by, and its backoff weight."""
    # P of the class of unseen words is never seen after a context, so 1 - seen is at least that
    mass, free = c + (lost <= 0), np.maximum(1 - seen, unseen)
    return np.maximum(mass, 1), np.where(c > 0, np.where(lost > 0, lost, 1.0) / np.maximum(mass, 1) / free, 1.0)


def score_all(docs: DataFrame, held_col: str = "held_out", id_col: str = "doc_id") -> DataFrame:
    """id, held, n_tokens, n_known, train_tokens, base_score, score; rows whose held_col is true don't train."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held"), F.col("text"))
    blocks = bucketed(slim.mapInArrow(_blocks, "block long, n long, ids array<long>, held array<boolean>, data binary"), "blocks", "block")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, total // BUCKET)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, hashes, counts, _ = _opened(data)
                ends = _ranges(hashes, buckets)
                rows = [_pack(h, c) for h, c in zip(np.split(hashes, ends[:-1]), np.split(counts, ends[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array(rows, pa.binary())], names=["block", "bucket", "data"])

    sent = blocks.select("block", "data").mapInArrow(words, "block long, bucket int, data binary")
    merged = bucketed(sent.groupBy("bucket").applyInArrow(_merge_words, "block long, bucket int, total long, types long, words long, small array<long>, data binary"), "unigrams", "block")
    t = merged.where("block = -1").agg(F.sum("total"), F.sum("types"), *[F.sum(F.get("small", F.lit(i))) for i in range(TOP + 1)], F.max("words")).first()
    stride = int(t[-1] or 0)  # ranges of hashes hold about as many words each, so numbers have few gaps
    uni = Unigrams(int(t[0] or 0), int(t[1] or 0), [int(x or 0) for x in t[2:-1]])
    answered = merged.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("words"))

    def known(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a block's words and their counts; the last number is that of the text's start."""
        parts = [(bucket, *_unpack(x)) for bucket, x in sorted((a["bucket"], a["data"]) for a in answers)]
        numbers = [bucket * stride + np.cumsum(steps, dtype=np.int64) for bucket, steps, _ in parts]
        return np.concatenate([*numbers, [buckets * stride]]).astype(np.uint64), np.concatenate([x for *_, x in parts])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pa.default_memory_pool().release_unused()  # of the batches before
            for i in range(b.num_rows):
                block, held, data, answers = (b.column(k)[i].as_py() for k in range(4))
                numbers, words_ = known(answers)
                del answers
                rows = list(_Bigrams(data, numbers, words_, uni, buckets).payloads(held, words_))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bucket", "data"])

    asked = blocks.join(answered, "block").select("block", "held", "data", "words").mapInArrow(pairs, "block long, bucket int, data binary")
    grams = written(asked.groupBy("bucket").applyInArrow(_merge_pairs, "bucket int, small array<long>, bigrams binary, blocks array<long>, asked binary"), "bigrams")
    of = grams.agg(*[F.sum(F.get("small", F.lit(i))) for i in range(TOP + 1)]).first()
    d = discounts(np.array([float(x or 0) for x in of]))


    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the contexts that may be dealt over several buckets."""
        for b in batches:
            for x in b.column(0):
                contexts, flags, at, counts, p = _table(x.as_py(), uni)
                c, lost, p = (s[flags > 0] for s in _sums(contexts, at, counts, p, d))
                contexts = contexts[flags > 0]
                yield pa.RecordBatch.from_arrays([pa.array(contexts.view(np.int64)), pa.array(c), pa.array(lost), pa.array(p)], names=["h", "c", "lost", "p"])

    # at most HOT + 1 contexts are hot: that bounds what is collected
    split = grams.select("bigrams").mapInArrow(hot_sums, "h long, c double, lost double, p double").groupBy("h").agg(F.sum("c").alias("c"), F.sum("lost").alias("lost"), F.sum("p").alias("p"))
    hot = split.toArrow()
    hot_h = np.asarray(hot.column("h").combine_chunks() if hot.num_rows else pa.array([], pa.int64())).astype(np.int64).view(np.uint64)
    by = np.argsort(hot_h)
    whole = sc.broadcast((hot_h[by], *(np.asarray(hot.column(x).combine_chunks() if hot.num_rows else pa.array([], pa.float64()))[by] for x in ("c", "lost", "p"))))


    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the bigrams and weights of the whole contexts, in the order in which each block asked."""
        for b in batches:
            pa.default_memory_pool().release_unused()  # of the batches before
            for i in range(b.num_rows):
                contexts, hot, at, counts, p = _table(b.column(1)[i].as_py(), uni)
                mass, alpha = _weights(*_sums(contexts, at, counts, p, d), uni.unseen)
                del p
                rows, blocks_ = [], b.column(2)[i].as_py()
                for steps in _unpack(b.column(3)[i].as_py()):
                    place = np.cumsum(steps, dtype=np.int64)
                    own = at[place]
                    own = own[np.r_[True, own[1:] != own[:-1]]]
                    own = own[hot[own] == 0]
                    rows.append(_pack(counts[place].astype(np.uint32 if uni.total < 1 << 32 else np.uint64), mass[own].astype(np.int64), alpha[own]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array([b.column(0)[i].as_py()] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["block", "bucket", "data"])

    second = grams.select("bucket", "bigrams", "blocks", "asked").mapInArrow(values, "block long, bucket int, data binary")
    second = second.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("found"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *sums_ = whole.value
        hot_mass, hot_alpha = _weights(*sums_, uni.unseen)
        for b in batches:
            pa.default_memory_pool().release_unused()  # of the batches before
            for i in range(b.num_rows):
                ids, held, data, answers, found = (b.column(k)[i].as_py() for k in range(5))
                numbers, words_ = known(answers)
                del answers
                g = _Bigrams(data, numbers, words_, uni, buckets)
                parts = [_unpack(x) for _, x in sorted((a["bucket"], a["data"]) for a in found)]
                r, own_mass, own_alpha = (np.concatenate(x) for x in zip(*parts, strict=True))
                del data, found, parts
                mass, alpha = np.ones(len(numbers)), np.ones(len(numbers))
                asked_ = g.context[g.order]  # a whole context lies in one bucket, so its bigrams are neighbours
                asked_ = asked_[np.r_[True, asked_[1:] != asked_[:-1]]]
                asked_ = asked_[~g.hot[asked_]]
                mass[asked_], alpha[asked_] = own_mass, own_alpha
                common = np.flatnonzero(g.hot)
                at = np.searchsorted(names, numbers[common])
                mass[common], alpha[common] = hot_mass[at], hot_alpha[at]
                counts = np.empty(len(r), np.int64)
                counts[g.order] = r
                del r, asked_
                p = alpha[g.context] * uni.p(words_)[g.word]
                met = np.flatnonzero(counts)
                r = counts[met]
                p[met] = np.where(r > TOP, 1.0, d[np.minimum(r, TOP)]) * r / mass[g.context[met]]
                logs = np.log10(p)
                del p, met, r, counts
                base = np.log10((words_ + 1) / (uni.total + uni.types + 1))
                sums = lambda x: np.add.reduceat(x, g.starts)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(g.lengths), pa.array(sums((words_ > 0)[g.tokens].astype(np.int64))), pa.array(sums(base[g.tokens])), pa.array(sums(logs[g.place]))], names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

    out = blocks.join(answered, "block").join(second, "block").select("ids", "held", "data", "words", "found").mapInArrow(final, "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(uni.total).cast("long"))


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return score_all(docs).select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_katz": op1_katz}
ORACLE_SQL: dict[str, str] = {}
