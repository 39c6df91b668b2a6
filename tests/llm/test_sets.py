"""Jaccard join, line chunks, mixing, nearest neighbours and licences against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from replicaql.llm import anisotropic, licenses, line_chunks, mixing, partenum

KINDS = "doc_id long, text string, source string, n_chars long, extra string"


def _frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else f"s{i % 3}", len(t or ""), "x") for i, t in texts], KINDS)


def _shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _components(texts, width, percent):
    sets = {i: _shingles(t, width) for i, t in texts}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def _copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return texts + ["", None, " ", "ONE", "one"]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join(spark, width, percent):
    texts = list(enumerate(_copies(random.Random(width), 40)))
    got = {r.id: (r.n, r.component_id) for r in partenum.join_components(_frame(spark, texts), width=width, percent=percent).collect()}
    assert got == _components(texts, width, percent)
    kept = {r.doc_id for r in partenum.keep_one(_frame(spark, texts), width=width, percent=percent).collect()}
    assert kept == {i for i, (n, c) in got.items() if n == 0 or c == i}


def test_join_by_way_of_a_null_id(spark):
    """Mutated copies, similar to their base only, whose own row has no id; and a copy of a named text without one."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = [(None, " ".join(base))]
    for i in range(6):
        t = list(base)
        for _ in range(2):
            t[20 + 30 * i + rng.randrange(10)] = f"own{i}"
        texts.append((i, " ".join(t)))
    texts += [(20, "alone here"), (None, "alone here"), (None, "nobody else"), (None, ""), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.id, r.component_id) for r in partenum.join_components(df, width=3, percent=90).collect()]
    named = _components([(100 if i is None and k == 0 else i, t) for k, (i, t) in enumerate(texts) if i is not None or k == 0], 3, 90)
    assert {named[i][1] for i in range(6)} == {0} and named[100][1] == 0
    assert sorted(got, key=str) == sorted([(None, 0), *((i, 0) for i in range(6)), (20, 20), (None, 20), *[(None, None)] * 3], key=str)


def test_one_row_of_each_component_stays(spark):
    """Ids shared by different texts, and rows without ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(1, a), (2, a + " z"), (2, "clean text of its own"), (3, b), (3, b + " z"), (4, b), (None, a), (None, c), (None, c + " z"), (None, "apart"), (None, None), (5, ""), (1, a)]
    kept = [(r.doc_id, r.text) for r in partenum.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert len(kept) == 7 and {(1, a), (2, "clean text of its own"), (None, "apart"), (None, None), (5, "")} <= set(kept)
    assert len({(3, b), (3, b + " z")} & set(kept)) == 1 and len({(None, c), (None, c + " z")} & set(kept)) == 1


def test_the_same_row_stays_in_every_run(spark):
    """Of rows that share id and text one stays, the same whatever the order of rows."""
    rows = [(i % 5, "one two three four five six seven" if i % 2 else None, f"s{i}", i, {"k": i}) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, tags map<string,int>")
    keep = lambda df: sorted(map(str, partenum.keep_one(df).collect()))
    first = keep(df.coalesce(1))
    assert first == keep(df.orderBy("n_chars", ascending=False).repartition(7)) and len(first) == 6
    assert keep(df.select("text", "doc_id")) and partenum.keep_one(df).columns == df.columns


def test_signatures_are_shared():
    rng = np.random.default_rng(4)
    for n in (1, 5, 19, 20, 100, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = int(0.052 * n)
            b = np.unique(np.r_[a[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                starts = partenum.bands(5000, 90)
                assert set(partenum.signatures(a, 90, starts)) & set(partenum.signatures(b, 90, starts))


def test_lines(spark):
    shared = "\n".join(f"shared line number {i} of the passage" for i in range(12))
    texts = [(i, f"start of {i}\n{shared}\nend of {i} here\nand {i}" if i < 4 else f"only {i}\nown {i}") for i in range(6)] + [(6, None), (7, ""), (8, "one line"), (9, "one line")]
    df = _frame(spark, texts)
    got = {r.doc_id: r for r in line_chunks.remove(df).collect()}
    assert set(got) == set(range(10)) and got[6].text is None and got[7].text == ""
    assert got[0].text == texts[0][1] and got[0].n_removed == 0  # the first occurrence stays
    for i in (1, 2, 3):
        assert got[i].n_removed >= 2 and f"start of {i}" in got[i].text and f"and {i}" in got[i].text
        kept = got[i].text.split("\n")
        assert kept == [x for x in texts[i][1].split("\n") if x in kept]
    assert all(got[i].text == t for i, t in texts[4:])
    assert set(df.columns) < set(line_chunks.remove(df).columns) and line_chunks.remove(df.limit(0)).count() == 0


def _repeats(texts, words=50):
    """Numbers of lines in runs of so many words, as short as they can be from or to a line, that stand earlier too."""
    first, out = set(), {}
    for i, t in texts:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.split()]
        many = lambda run: sum(len(lines[k].split()) for k in run) >= words
        chunks = {(k, next((e for e in at if many([x for x in at if k <= x <= e])), None)) for k in at} | {(next((b for b in reversed(at) if many([x for x in at if b <= x <= k])), None), k) for k in at}
        chunks = sorted(c for c in chunks if None not in c and c[0] <= c[1])
        out[i] = set()
        for s, e in chunks:
            if (key := "\n".join(lines[s : e + 1])) in first:
                out[i].update(range(s, e + 1))
            first.add(key)
    return out


@pytest.mark.parametrize("n,words", [(1, 60), (2, 30), (6, 10), (8, 8), (12, 10)])
def test_passages_go_whole(spark, n, words):
    """Planted passages of over 50 words, at the start, in the middle and at the end of texts that differ."""
    rng = random.Random(n)
    line = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    passage = [line(words) for _ in range(n)]
    texts, at = [], {}
    for i in range(60):
        before, after = ([line(rng.randrange(1, 70)) for _ in range(k)] for k in rng.choice([(0, 3), (3, 0), (2, 4), (0, 1)]))
        before += [""] * (i % 2 if before else 0)
        texts.append((i, "\n".join(before + passage + after)))
        at[i] = set(range(len(before), len(before) + n))
    got = {r.doc_id: r for r in line_chunks.remove(_frame(spark, texts)).collect()}
    assert got[0].text == texts[0][1] and got[0].n_removed == 0
    for i, t in texts[1:]:
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in at[i]) and got[i].n_removed == n


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["", " ", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 49, 50, 80]))) for _ in range(40))]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    want = _repeats(texts)
    got = {r.doc_id: r for r in line_chunks.remove(_frame(spark, texts)).collect()}
    for i, t in texts:
        assert got[i].n_removed == len(want[i]) and got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
    assert {x for r in got.values() for x in r.text.split("\n")} >= {x for _, t in texts for x in t.split("\n") if x.strip()}


def test_short_lines_that_recur_stay(spark):
    """Fewer than 50 words in a row are no passage, however often they stand."""
    tales = [f"the tale of {i}\nYes.\nNo.\n}}\n}}\nand so on for {i}" for i in range(30)]
    got = line_chunks.remove(_frame(spark, list(enumerate(tales))))
    assert got.agg({"n_removed": "sum"}).first()[0] == 0
    passage = "\n".join(["thirty " * 30, "twenty " * 15, "ends so"])
    got = line_chunks.remove(_frame(spark, [(i, f"own {i} words\n{passage}\nmore {i}") for i in range(6)]))  # 47 words
    assert got.agg({"n_removed": "sum"}).first()[0] == 0
    passage = "\n".join(["thirty " * 30, "twenty " * 25, "ends so"])  # its last line reaches 50 words only backwards
    got = {r.doc_id: r.n_removed for r in line_chunks.remove(_frame(spark, [(i, f"own {i} words\n{passage}\nmore {i}") for i in range(6)])).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 6), 3)


def test_long_texts_of_lines(spark):
    """A text of 100,000 lines, of one word each, and one line of a megabyte."""
    many = "\n".join(f"w{i % 70_000}" for i in range(100_000))
    df = _frame(spark, [(0, many), (1, "x " * 500_000), (2, "x " * 500_000), (3, "y\n" * 30_000)])
    got = {r.doc_id: r for r in line_chunks.remove(df).collect()}
    assert got[0].n_lines == 100_000 and got[0].n_removed == 30_000 and (got[1].n_removed, got[2].n_removed) == (0, 1) and got[2].text == ""
    assert got[3].n_lines == 30_001 and got[3].text.replace("\n", "") == "y"  # equal chunks overlap: the first line is in none that goes


def _quotients(votes, seats):
    q = [0] * len(votes)
    for _ in range(seats if sum(votes) > 0 else 0):
        i = max(range(len(q)), key=lambda i: (votes[i] / (2 * q[i] + 1), -i))
        q[i] += 1
    return q


def test_apportionment(spark):
    """Many groups at once against the plain loop over quotients: ties, zeros, and one shard beside many small ones."""
    rng = random.Random(1)
    groups = [([float(rng.choice([0, 1, 7, 7, 50, 99])) for _ in range(rng.randrange(1, 9))], rng.randrange(0, 60)) for _ in range(40)]
    groups += [([150_000.0] + [1_504.0] * 100, 2_000), ([1.0] * 9, 4), ([5.0, 0.0], 3)]
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(groups) for i, v in enumerate(votes)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g long, i long, v double, s long"), ["g"], "v", "s", "i").collect()
    found = {(r.g, r.i): r.quota for r in got}
    assert len(got) == len(rows)
    for g, (votes, s) in enumerate(groups):
        assert [found[g, i] for i in range(len(votes))] == _quotients(votes, s), (votes, s)


def test_tied_quotients_end_the_search(spark, monkeypatch):
    tables = []
    keep = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: tables.append(name) or keep(df, name))
    votes = [70_001.0] * 7 + [3_000.0, 5.0]  # seven tie for the last seats
    rows = spark.createDataFrame([(0, i, v, 5_003) for i, v in enumerate(votes)], "g long, i long, v double, s long")
    got = {r.i: r.quota for r in mixing.sainte_lague(rows, ["g"], "v", "s", "i").collect()}
    assert [got[i] for i in range(len(votes))] == _quotients(votes, 5_003)
    assert len({got[i] for i in range(7)}) == 2 and len(tables) <= 7, tables


def test_targets(spark):
    goal = lambda sizes, w: [r.target for r in mixing.targets(spark.createDataFrame([(i, s, float(x)) for i, (s, x) in enumerate(zip(sizes, w))], "i long, size long, weight double"), 3).orderBy("i").collect()]
    # 30 and then 360 are above three times their sizes, so both stop there
    assert goal([100, 1000, 10], [1, 2, 3]) == pytest.approx([300, 780, 30])
    assert goal([], []) == [] and goal([0, 0], [1, 2]) == [0, 0]


def test_mix(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(["w"] * rng.randrange(0, 400))) for i in range(600)] + [(600, None), (601, "")] + [(5, "a row many times over")] * 50
    sources = {i: ["a", "b", "c", None][min(i % 7, 3)] for i, _ in texts}
    df = _frame(spark, texts, sources)
    plan = mixing.mix(df).collect()
    assert sum(r.rows for r in plan) == len(texts)
    rows = mixing.mixed_rows(mixing.mix(df)).collect()
    assert len(rows) == len(texts) and sorted(rows, key=str) == sorted(mixing.mixed_rows(mixing.mix(df.repartition(3))).collect(), key=str)
    for s in set(sources.values()):
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=64)
        assert own[0].source_size == sum(r.size for r in own) and all(r.taken <= 3 * r.size for r in own)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df).columns == df.columns


def test_blocks_before_a_place(spark):
    """Counted by quotients or block by block, a shard gives up as many words, and its quota of blocks in all."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        size = rng.randint(1, 900)
        full = size // 64
        rows.append((i, size, full, rng.randint(0, full + (size % 64 > 0)), rng.randrange(max(1, full)), rng.randint(0, size)))
    df = spark.createDataFrame(rows, "i long, size long, full long, quota long, turn long, at long")
    for r in df.select("*", mixing.taken_before(F.col("at"), 64).alias("got"), mixing.taken_before(F.col("size"), 64).alias("whole")).collect():
        q, n = min(r.quota, r.full), max(1, r.full)
        blocks = [(k + 1 + r.turn) * q // n > (k + r.turn) * q // n for k in range(r.full)] + [r.quota > r.full]
        assert sum(blocks) == r.quota
        assert r.got == sum(blocks[w // 64] for w in range(r.at)) and r.whole == sum(blocks[w // 64] for w in range(r.size))


def test_mix_of_a_hot_row(spark, monkeypatch):
    """A row of a million copies of a hundred words is counted without its blocks; copies that leave in parts are all there."""
    monkeypatch.setattr(mixing, "COPIES", 1000)
    hot = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.lit("h").alias("source"), F.repeat(F.lit("w "), 100).alias("text"))
    rest = spark.range(1000).select(F.col("id") + 2, F.lit("a"), F.repeat(F.lit("v "), 50))
    rows = mixing.mixed_rows(mixing.mix(hot.union(rest))).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("taken").alias("most")).collect()
    got = {r.source: r for r in rows}
    assert got["h"].n == 1_000_000 and got["a"].n == 1000 and got["a"].taken == 150_000 and got["h"].most <= 300
    assert abs(got["h"].taken - got["h"].target) <= 64 and got["h"].taken + got["a"].taken <= 100_050_000 + 64


def test_mix_of_capped_sources(spark):
    """Targets that stop at three times their source, sources of less than a block, and clashing columns."""
    rows = [(0, "w " * 30, "a", "x"), (1, "w " * 5, "b", "y"), (2, "w " * 40, "c", "z"), (3, "v " * 900, "d", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = {r.source: (r.target, r.taken) for r in mixing.mixed_rows(mixing.mix(df)).collect()}
    assert got["a"] == (90.0, 90) and got["b"] == (15.0, 15) and got["c"] == (120.0, 120) and got["d"][1] == pytest.approx(750, abs=64)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and sorted(r.doc_id for r in mixed.collect() if r.doc_id < 3) == [0] * 3 + [1] * 3 + [2] * 3


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 17))
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(1500)] + [(2000, None), (2001, [0.0] * 17), (2002, [None] * 17), (2003, [float("nan")] * 17), (2004, [1.0]), (None, [1.0] * 17)]
    got = anisotropic.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(d[i]) for _, i, s in own)
        hit += len({i for _, i, _ in own} & set(np.argsort(d)[:10]))
    assert hit >= 0.9 * 150 and len(got) == 150
    assert anisotropic.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert anisotropic.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).count() == 1


def test_nearest_among_copies(spark):
    """Thousands of exact and of near copies: each query gets what brute force gives, ties by the smaller id."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((9000, 16))
    v[rng.permutation(9000)[:6000]] = 0
    same = np.flatnonzero(~v.any(1))
    v[same[:3000]] = rng.standard_normal(16)
    v[same[3000:]] = rng.standard_normal(16) + 0.01 * rng.standard_normal((3000, 16))
    rows = [(int(i), [float(x) for x in v[i]]) for i in rng.permutation(9000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r.rank): r.vec_id for r in anisotropic.nearest(df).collect()}
    for q in range(0, 9000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q, r] for r in range(1, 11)] == np.lexsort((np.arange(9000), d))[:10].tolist()


def test_nearest_extremes(spark):
    """One huge vector leaves the others' neighbours as they are; equal vectors tie by id; ids that repeat are rows of their own."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((700, 8))
    v[100:400] = v[100]  # 300 equal vectors, far from most queries
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(700)] + [(9001, [1e40] * 8), (9002, [1e-40] * 8), (200, [float(x) for x in v[100]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in anisotropic.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, mat = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    for q in (0, 100, 300, 400, 500, 600):
        d = np.sqrt(((mat - mat[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert [w for _, w, _ in sorted(got[q])] == ids[want].tolist(), q
        assert [s for _, _, s in sorted(got[q])] == pytest.approx(d[want].tolist())
    assert len(got[200]) == 20  # two rows, each a query


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a shared line here\nand another one", "x", "y", i) for i in range(3)], "doc_id long, text string, gone string, _id string, lines int")
    got = line_chunks.remove(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and sorted((r.doc_id, r.gone, r._3, r.lines) for r in got.withColumnRenamed("_id", "_3").collect()) == [(i, "x", "y", i) for i in range(3)]


def test_cells_are_a_lower_bound():
    rng = np.random.default_rng(8)
    for n in (1, 3, 40, 900, 30_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[n // 5 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)])
        m = partenum._folded([partenum.cells(a), partenum.cells(b)])
        least = np.where((m < 0).any(0), 0, np.abs(m[0] - m[1])).sum()
        assert least <= len(np.setxor1d(a, b))
        assert partenum.may_be_similar(m[0], len(a), m[1:], np.array([len(b)]), 60)[0]


def test_large_buckets(spark, monkeypatch):
    """The way for buckets that are too large for one task gives the same components."""
    monkeypatch.setattr(partenum, "TESTS", 0)
    texts = list(enumerate(_copies(random.Random(11), 12)))
    got = {r.id: (r.n, r.component_id) for r in partenum.join_components(_frame(spark, texts), width=5, percent=80).collect()}
    assert got == _components(texts, 5, 80)


def test_pipeline(spark, tmp_path):
    """All stages on an ordinary, an empty and a null-laden table."""
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda k: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(500)) for _ in range(12)) for _ in range(k))
    long = [text(8) for _ in range(20)]
    plain = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(long)] + [(100, long[0], "en", "s0", 1), (101, long[1] + " more", "en", "s1", 1), (102, "too short", "en", "s1", 9)]
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (None, long[3], None, None, None), (3, " \n ", "en", "s", 3), (4, long[4], "en", None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("plain", plain), ("none", []), ("odd", odd)):
        spark.createDataFrame(rows, kinds).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        if name == "plain":
            assert {r.doc_id for r in out} <= {*range(20), 100, 101} and len({r.text for r in out}) >= 10 and 102 not in {r.doc_id for r in out}
        else:
            assert {r.text for r in out} <= ({long[3], long[4]} if name == "odd" else set())
        assert all(r.round_trip for r in out)


def _licences(texts):
    """Each text's results from the definition: words looked up, starts, key phrases and shares, in plain loops."""
    files = [re.findall(licenses.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = {w: math.log((len(files) + 1) / (sum(w in f for f in files) + 1)) + 1 for w in licenses.VOCABULARY}
    out = []
    for f in files:
        at = sorted(k for _, p in licenses.BASE for k in range(len(f)) if f[k : k + len(p.split())] == p.split())
        base = {n for n, p in licenses.BASE for k in range(len(f)) if f[k : k + len(p.split())] == p.split()}
        labels, score = set(base), 0.5 if at else 0.0
        rare = {w for _, words, _ in licenses.TEMPLATES for w in sorted(set(words) & set(f), key=lambda w: (-idf[w], w))[: licenses.RARE]}
        for label, words, key in licenses.TEMPLATES:
            first = next(j for j in range(len(words)) if words[j : j + len(key)] == key)
            agree = {}
            for p, w in enumerate(f):
                if w in rare:
                    for j, x in enumerate(words):
                        if x == w and p >= j:
                            agree.setdefault(p - j, set()).add(w)
            for start, seen in agree.items():
                if len(seen) > 1 and f[start + first : start + first + len(key)] == key:
                    labels.add(label)
                    score = max(score, sum(idf[w] for j, w in enumerate(words) if start + j < len(f) and f[start + j] == w) / sum(idf[w] for w in words))
        out.append((len(f), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


def test_licenses(spark):
    rng = random.Random(2)
    texts = ["Released under the MIT License.", "MIT-license and mit  license", "nothing here", "", None, "GNU General Public License", "general licence public license", "Licensed under CC BY-NC 4.0.", "the Apache\nLicense, Version 2.0", "mit é license"]
    for _, text, _ in licenses.TEXTS:
        words = text.split()
        texts.append("some code " * rng.randrange(50) + text)  # whole
        for _ in range(3):  # with words put in and left out
            w = list(words)
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice([[], ["Inc"], ["the", "said"]])
            texts.append(" ".join(["x"] * rng.randrange(9) + w + ["y"] * rng.randrange(9)))
    texts += [" ".join(t for _, t, _ in licenses.TEXTS), " ".join(licenses.VOCABULARY), " ".join(rng.choice(licenses.VOCABULARY) for _ in range(3000)), licenses.TEXTS[0][1], licenses.TEXTS[0][1]]
    df = spark.createDataFrame([(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, row int").coalesce(1)
    indexed = licenses.index(df)
    got = [tuple(r)[1:] for r in licenses.scan(indexed, licenses.weights(indexed)).select("doc_id", *licenses.RESULTS).collect()]
    key = lambda r: (str(r[:6]), round(r[6], 9))
    for g, w in zip(sorted(got, key=key), sorted(_licences(texts), key=key), strict=True):
        assert g[:6] == w[:6] and g[6] == pytest.approx(w[6])
    empty = licenses.index(df.limit(0))
    assert licenses.scan(empty, licenses.weights(empty)).count() == 0


def test_notices_say_where(spark):
    """A whole licence behind 40 words, with a word put in after its first 30: found where it starts, and its rest 1 later."""
    text = next(t for label, t, _ in licenses.TEXTS if label == "isc").split()
    df = spark.createDataFrame([(1, " ".join(["code"] * 40 + text[:30] + ["Inc"] + text[30:]))], "doc_id long, text string")
    indexed = licenses.index(df)
    found = licenses.notices(indexed, dict.fromkeys(licenses.VOCABULARY, 1.0)).collect()
    isc = [(r.start, r.share) for r in found if licenses.TEXTS[r.licence][0] == "isc"]
    # 31 words: "and/or" is two; the rest is shifted, but for words that happen to stand in place
    assert len(isc) == 1 and isc[0][0] == 40 and 31 / len(licenses.TEMPLATES[13][1]) < isc[0][1] + 1e-9 < 0.4


def test_repeated_notices_take_linear_time(spark):
    df = spark.createDataFrame([(1, "mit license " * 100_000), (2, licenses.TEXTS[12][1] * 200)], "doc_id long, text string")
    indexed = licenses.index(df)
    rows = {r.doc_id: r for r in licenses.scan(indexed, licenses.weights(indexed)).collect()}
    assert (rows[1].n_words, rows[1].n_base, rows[1].labels) == (200_000, 100_000, "mit") and rows[2].labels == "mit" and rows[2].score == pytest.approx(1.0)


def test_passes_make_every_signature_once():
    rng = np.random.default_rng(5)
    for n in (1, 2, 19, 300, 2000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        whole = partenum.signatures(s, 80, partenum.bands(9000, 80))
        turns = [partenum.signatures(s, 80, partenum.bands(9000, 80), 4, turn) for turn in range(4)]
        assert sorted(np.concatenate(turns)) == sorted(whole)


def test_texts_of_the_kept_rows_do_not_move(spark):
    """Texts of different ids: none has to meet another; the repeated row's does."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(3000)), "s") for i in range(40)]
    df = spark.createDataFrame([*rows, rows[0], (40, rows[1][1], "s")], "doc_id long, text string, source string").repartition(4).localCheckpoint()
    moved = lambda: sum(x.totalShuffleWrite() for x in (found.apply(i) for i in range(found.size())))
    kept = partenum.keep_one(df)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before, ids = moved(), sorted(r.doc_id for r in kept.collect())
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    assert ids == list(range(40))
    assert moved() - before < 4 * 3000 * 16  # two texts, and no more than that again
