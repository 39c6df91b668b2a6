"""Collision-counting links, whitening and the filter audit against brute force."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from replicaql.llm import collisions, filter_audit, whitening

VECTORS = "vec_id long, embedding array<double>, label string, n_links string, cell int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], VECTORS)


def _links(rows, cosine=0.98):
    """(id, n_links, component_id, kept) of each row, sorted as text."""
    ok = [v is not None and y is not None and i is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, v, y in rows]
    unit = [np.array(v) / np.abs(v).max() if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    comp, out = {}, []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    for i, (vid, _, _) in enumerate(rows):
        out.append((vid, len(near[i]), comp[i], None if vid is None else vid == comp[i]))
    return sorted(out, key=repr)


def _crowd(rng, dim, n, spread):
    base = rng.standard_normal(dim)
    base /= np.linalg.norm(base)
    return [(base + spread * rng.standard_normal(dim) / math.sqrt(dim)).tolist() for _ in range(n)]


@pytest.mark.parametrize("dim,block", [(64, 2048), (64, 7), (3, 16), (1, 2048), (17, 5)])
def test_links(spark, dim, block):
    rng = np.random.default_rng(dim + block)
    rows = []
    for label in "ab":
        for spread in (0.05, 0.12, 0.14, 0.16):  # pairs about the threshold
            rows += [(len(rows) + k, v, label) for k, v in enumerate(_crowd(rng, dim, 25, spread))]
        rows += [(len(rows) + k, v, label) for k, v in enumerate(rng.standard_normal((20, dim)).tolist())]
    rows += [(900 + k, rows[3][1], "a") for k in range(9)]  # copies of all components
    rows += [(950, [2 * c for c in rows[3][1]], "a"), (951, [1e300 * c for c in rows[3][1]], "a"), (952, [1e-300 * c for c in rows[3][1]], "a"), (953, rows[3][1], "b")]
    rows += [(5, rows[30][1], "a"), (5, rows[30][1], "a"), (960, rows[3][1], None), (None, rows[3][1], "a"), (961, None, "a"), (962, [0.0] * dim, "a"), (963, [float("nan"), *rows[3][1][1:]], "a"), (964, [None, *rows[3][1][1:]], "a")]
    rows += [(965, [float("inf"), *rows[3][1][1:]], "a"), (966, [], "a"), (967, [*rows[3][1], 0.0], "a"), (968, [*rows[3][1], 0.0], "a"), (969, [-0.0, *rows[3][1]], "a"), (970, [0.0, *rows[3][1]], "a")]
    got = collisions.near_duplicates(_vectors(spark, rows), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == _links(rows)
    assert got.columns == ["id", "n_links", "component_id", "kept"]


def test_no_vectors(spark):
    assert collisions.near_duplicates(_vectors(spark, [])).count() == 0
    assert [tuple(r) for r in collisions.near_duplicates(_vectors(spark, [(3, None, "a")])).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("misses", [0, 1, 3])
def test_window_keeps_pairs_at_the_threshold(misses):
    """Of pairs whose cosine is the threshold the calibrated share collides often enough."""
    dim, rng, recall = 32, np.random.default_rng(misses), 0.99
    half = collisions.window(0.98, dim, 24, misses, recall)
    found = 0
    for _ in range(4000):
        u = rng.standard_normal(dim)
        u /= np.linalg.norm(u)
        o = rng.standard_normal(dim)
        o -= (o @ u) * u
        v = 0.98 * u + math.sqrt(1 - 0.98**2) * o / np.linalg.norm(o)
        r = rng.standard_normal((dim, 24)) / math.sqrt(dim)
        found += (np.abs((u - v) @ r) <= half).sum() >= 24 - misses
    assert abs(found / 4000 - recall) < 0.006


def _whitened(rows, k):
    """By the covariance and its eigenvectors."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**52 for c in v)]
    lengths = [len(v) for _, v in fine]
    dim = min(set(lengths), key=lambda d: (-lengths.count(d), d))
    fine = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in fine if len(v) == dim]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][: min(k, dim)], q[:, ::-1][:, : min(k, dim)]
    q, e, trace = q[:, e > 1e-12 * e[0]], e[e > 1e-12 * e[0]], e.sum()
    q *= np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    out = []
    for i, x in fine:
        dev = [n * c - s for c, s in zip(x, sums, strict=True)]
        far = sum(d * d for d in dev)
        out += [(i, j + 1, n, far if far < 2**63 else None, float(np.array([float(d) / n for d in dev]) @ q[:, j] / math.sqrt(e[j]))) for j in range(len(e))]
    return sorted(out, key=repr), trace


def _compare(spark, rows, k, block=None, tol=1e-6):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, x string")
    got = whitening.whitened(df, k=k, block=block).collect()
    want, _ = _whitened(rows, k)
    assert len(got) == len(want)
    got = sorted(got, key=lambda r: repr(tuple(r)[:4]))
    want.sort(key=lambda r: repr(r[:4]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:4] == w[:4] and abs(g.whitened - w[4]) < tol, (g, w)
        assert g.identity_error < 1e-9
    return got


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 24)) * np.linspace(3, 0.5, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0] + 5
    rows = list(enumerate(x.tolist()))
    rows += [(7, rows[7][1])] * 80 + [(None, rows[9][1]), (400, None), (401, [float("nan")] * 24), (402, [None] * 24), (403, [math.inf] * 24), (404, [0.0] * 24), (405, []), (406, [1.0] * 5), (407, [1e200] * 24)]
    got = _compare(spark, rows, 5)
    assert abs(sum(r.explained for r in got if r.id == 0) - sum(sorted(np.linalg.eigvalsh(np.cov(x.T)))[-5:]) / np.trace(np.cov(x.T))) < 0.01


def test_whitening_by_passes(spark):
    """A block narrower than the vectors: passes until the residuals certify."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 40)) * (20 * 0.75 ** np.arange(40))
    _compare(spark, list(enumerate(x.tolist())), 4, block=10)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(whitening, "PASSES", 2)
        with pytest.raises(ArithmeticError, match="residuals"):
            _compare(spark, list(enumerate(x.tolist())), 4, block=5)


def test_whitening_of_few_or_large_vectors(spark):
    _compare(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 0.5]), (3, [1.0, 2.0, 0.5])], 16)  # one direction only
    _compare(spark, [(1, [1e15, 0.0]), (2, [-1e15, 3e15]), (3, [5.0, 2.0])], 2, tol=1e-3)  # no long holds the deviations
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(df).count() == 0 and whitening.whitened(df.limit(0)).count() == 0


def _audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [t or "" for _, t, _ in docs]
    first = {}
    for (i, _, _), t in zip(docs, texts, strict=True):
        if i is not None:
            first[t] = min(i, first.get(t, i))
    rows = []
    for (i, _, lang), t in zip(docs, texts, strict=True):
        w = word.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((lang or "", fails, any(a == i and q == 1 for a, q, _ in labels) and i is not None, any(a == i and x == 1 for a, _, x in labels) and i is not None))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        made = []
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone, alive_next = [r for r in alive if r[1][f]], [r for r in alive if not r[1][f]]
                removed_by[f] += len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                made.append((part, "".join(order), step, len(alive_next), len(gone), sum(r[1][f] for r in mine) - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
                alive = alive_next
        out += [(*m[:-1], removed_by[m[-1]]) for m in made]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["Cap", "CAPS", "#tag", "é"]
    docs = []
    for i in range(150):
        n = rng.choice([0, 1, 150, 199, 200, 201, 260])
        pool = words[: rng.choice([20, 304])] + rng.choice([[], ["A$"], ["SHOUT"] * 60])
        docs.append((i, " ".join(rng.choice(pool) for _ in range(n)), rng.choice(["en", "de", None, ""])))
    docs += [(i + 200, docs[i][1], rng.choice(["en", "fr"])) for i in range(40)] + [(210, docs[10][1], "en"), (3, docs[10][1], "en"), (None, docs[10][1], "en"), (None, None, None), (999, None, "en"), (1000, "x " * 40_000, "en"), (0, docs[0][1], "en"), (-5, docs[20][1], "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(180)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (210, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "p", True) for x in docs], "doc_id long, text string, lang string, n int, part string, E boolean").repartition(5)
    y = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(d, y)
    assert sorted(map(tuple, got.collect())) == _audit(docs, labels)
    assert filter_audit.audit(d.limit(0), y).count() == 0 and filter_audit.audit(d.where("lang = 'zz'"), y.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
