"""Katz, pieces, toxicity, quality neighbours and rules against brute force or held-out truth."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replicaql.llm import common, host_rules, katz, neighbours, pieces, toxicity

KINDS = "doc_id long, text string, source string, extra string"
TEXTS = ["The cat sat on the mat the cat", "a b a b a b a b", "", None, "  \n\t ", "the cat sat on a hat " * 40, "Ünïcode ▁ text x 😀 the cat", "the cat sat on the mat the cat"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s0", "s0", None][i % 3], "x") for i, t in enumerate(TEXTS * 4)] + [(None, "the end", "s0", "x"), (1, TEXTS[1], "s0", "x")]
    return spark.createDataFrame(rows, KINDS)


def _discounts(counts):
    """Katz's Good-Turing discounts of counts 1 to 5, written from the definition."""
    n = [0] + [sum(c == r for c in counts) for r in range(1, 7)]
    d = {r: 1.0 for r in range(1, 6)}
    if n[1]:
        cut = 6 * n[6] / n[1]
        for r in range(1, 6):
            if n[r] and n[r + 1] and cut < 1:
                v = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                d[r] = v if 0.05 < v < 1 else 1.0
        d[1] = min(d[1], 0.95)
    return lambda r: d.get(r, 1.0)


def _katz(rows):
    """Each row's tokens scored by a model of plain dictionaries, and the sum of each context's probabilities."""
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [tok(t) for _, t, h in rows if not h]
    c1 = Counter(w for s in train for w in s)
    c2 = Counter(p for s in train for p in zip([None, *s], s))
    n = sum(c1.values())
    d1, d2 = _discounts(list(c1.values())), _discounts(list(c2.values()))
    lost1 = sum((1 - d1(c)) * c for c in c1.values())
    whole1 = n if lost1 > 0 else n + 1
    p1 = lambda w: d1(c1[w]) * c1[w] / whole1 if c1[w] else (lost1 if lost1 > 0 else 1) / whole1
    after = {}
    for (h, w), r in c2.items():
        after.setdefault(h, {})[w] = r

    def p(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        lost = sum((1 - d2(r)) * r for r in seen.values())
        whole = sum(seen.values()) + (0 if lost > 0 else 1)
        if w in seen:
            return d2(seen[w]) * seen[w] / whole
        return (lost if lost > 0 else 1) / whole / (1 - sum(p1(x) for x in seen)) * p1(w)

    sums = [sum(p(h, w) for w in c1) + p(h, "unseen") for h in after]
    return n, [(i, len(tok(t)), sum(c1[w] > 0 for w in tok(t)), sum(math.log10((c1[w] + 1) / (n + len(c1) + 1)) for w in tok(t)), sum(math.log10(p(h, w)) for h, w in zip([None, *tok(t)], tok(t)))) for i, t, _ in rows], sums


def _same_katz(held, rows):
    n, want, sums = _katz(rows)
    assert all(abs(s - 1) < 1e-12 for s in sums)  # every context sums to one
    got = katz.score_all(held).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted([(r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], key=key)
    for g, w in zip(found, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-11) and g[4] == pytest.approx(w[4], rel=1e-11)
    assert all(r.train_tokens == n for r in got)


def test_katz(docs):
    held = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    rows = [(r.doc_id, r.text, r.held_out) for r in held.collect()]
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, _, h in rows)
    _same_katz(held, rows)
    assert katz.score_all(held.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["a b c " * 9, "b c a " * 9, "a b x"], ["a a a a a a a a", "a a a a a a a a", "z"], ["one two three", "four one two", "one z two"]])
def test_katz_corners(spark, texts):
    """Corpora without singletons, with frequent bigrams alone, and contexts after which every word is seen."""
    rows = [(i, t, i == len(texts) - 1) for i, t in enumerate(texts)]
    _same_katz(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), rows)


def _best(p: pieces.Pieces, text: str) -> float:
    """Viterbi over the whole text with a dictionary."""
    table = {p.raw[i]: p.scores[i] for i in range(len(p.raw)) if p.trie_ids.get(i)}
    raw = (" " + text).encode()
    score = [0.0] + [-math.inf] * len(raw)
    for i in range(len(raw)):
        if score[i] == -math.inf:
            continue
        wide = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        for j in range(i + 1, min(i + 60, len(raw)) + 1):
            if raw[i:j] in table:
                score[j] = max(score[j], score[i] + table[raw[i:j]])
        if raw[i : i + wide] not in table:
            score[i + wide] = max(score[i + wide], score[i] + p.unknown)
    return score[-1]


def test_pieces(spark, docs):
    p = pieces.Pieces.load(pieces.MODEL)
    p.trie_ids = {i: True for i in range(len(p.raw)) if i not in set(p.byte_ids) and i > 2}
    for text in ["Hello world", "  two  spaces\n\ttabs ", "▁ marker ▁▁", "naïve façade 😀", "internationalization " * 5, "x"]:
        ids = np.frombuffer(p.encode(text), "<i4").tolist()
        assert p.decode(ids) == text
        single, total, i = set(p.byte_ids), 0.0, 0
        while i < len(ids):
            if ids[i] in single:
                lead = p.raw[ids[i]][0]
                total, i = total + p.unknown, i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            else:
                total, i = total + p.scores[ids[i]], i + 1
        assert total == pytest.approx(_best(p, text))
    out = pieces.encode_documents(docs)
    assert {r.text: r.decoded for r in pieces.decode_documents(out).collect()} == {t: t for t in [*TEXTS, "the end"]}
    assert out.where("not round_trip").count() == 0 and out.where("text is null and ids is not null").count() == 0
    assert set(out.columns) > set(docs.columns) and pieces.encode_documents(docs.limit(0)).count() == 0


def test_toxicity(spark):
    clean = [f"some plain words about number{i} and weather" for i in range(60)]
    bad = [f"you idiot moron and {w} person" for w in ("idiot", "scumbag", "moron") for _ in range(10)]
    bad = [f"{x} {i}" for i, x in enumerate(bad)]
    m = toxicity.Toxicity(clean + bad, [0] * len(clean) + [1] * len(bad))
    for text in ("what an idiot", "what an 1d10t", "such an i d i o t", "iiidiooot!", "an i.d.i.o.t here", "m0r0n"):
        assert m.score(text) >= 0.7, text
    for text in (None, "", "plain weather words", "password=3da3a2ce706927ddf6", "a b c d e f", "1 2 3"):
        assert m.score(text) < 0.7, text
    assert toxicity.Toxicity([], []).score("idiot") < 0.1


@pytest.mark.parametrize("run,column,n,share", [("op10_toxicity", "toxic", 3, 0.75), ("op4_neighbour_quality", "quality", 5, 0.97)])
def test_held_out(spark, run, column, n, share):
    d = "/root/testdata/sf0.01"
    f = toxicity.op10_toxicity if n == 3 else neighbours.op4_neighbour_quality
    rows = f(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[column] for r in rows]) > 0.93
    assert np.mean([r.predicted == r[column] for r in rows if r[column] == 1]) > share


def test_neighbours_edges(spark, docs):
    m = neighbours.Neighbours(["plain words here", "JUNK!! JUNK!!"], [1, 0])
    out = neighbours.score_documents(docs, m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert neighbours.Neighbours([], []).score(np.zeros((1, neighbours.N), np.float32))[0] == 0.5


def test_neighbours_against_brute_force(spark):
    """Every sample row is compared one by one; of equal ones the earlier count, whatever their labels."""
    rng = random.Random(8)
    word = lambda: rng.choice(["plain", "Words", "HERE", "junk!!", "42", "x%", "some", "text,", "of", "all"])
    base = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts = [rng.choice(base) for _ in range(300)]  # each about ten times, with labels that differ
    m = neighbours.Neighbours(texts, [rng.randint(0, 1) for _ in texts], k=15)
    asked = [*base, *(" ".join(word() for _ in range(20)) for _ in range(60)), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in neighbours.score_documents(df.repartition(3), m).collect()}
    f = neighbours.Features()
    for i, t in enumerate(asked):
        v = (f.of(t).astype(float) * m.idf) @ m.basis.astype(float)
        if not (t or "").split() or np.linalg.norm(v) <= 1e-6:
            assert got[i] == m.prior
            continue
        sims = [float(v @ m.vectors[p].astype(float)) / np.linalg.norm(v) for p in m.place]
        # sums of products differ in their last digits, so only neighbours that are equal in six may be told apart otherwise
        ranked = sorted(range(len(texts)), key=lambda j: (-round(sims[j], 6), j))[:15]
        w = [max(sims[j], 0) ** 4 for j in ranked]
        assert got[i] == pytest.approx(sum(x * m.labels[j] for x, j in zip(w, ranked)) / sum(w), abs=1e-4), t
    assert neighbours.score_documents(df.limit(0), m).count() == 0


def _rules(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_rules(spark, docs):
    for text in [*TEXTS, "a b c d a b c", "x # | y\nx # | y\n\n x", "w " * 60, "a b \x0b c\x85d"]:
        assert host_rules.measure(text)[:5] == _rules(text), text
    kept = host_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    long = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, long, "good", "") for i in range(50)] + [(99, junk, "good", "")] + [(100 + i, junk, "bad", "") for i in range(50)] + [(200, long, "bad", "")]
    ids = {r.doc_id for r in host_rules.filter_documents(spark.createDataFrame(rows, KINDS)).collect()}
    assert ids == {*range(50), 99, 200}  # soft rules are waived on the good host; clean documents stay on the bad one
    assert host_rules.filter_documents(docs.limit(0)).count() == 0


def test_oracles(spark):
    """Queries against their SQL on whole tables."""
    import duckdb

    from replicaql.llm import registry

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, d)
        columns = sorted(df.columns)
        want = con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()), name


def test_host_trust(spark):
    """The prior is fitted by moments and decides whom to trust: as computed by hand for each host."""
    long, junk = " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i}###" for i in range(80))
    sizes = {"a": (40, 1), "b": (40, 20), "c": (2, 0), "d": (300, 12), None: (10, 5)}
    rows = [(i, junk if i < bad else long, h, "") for h, (n, bad) in sizes.items() for i in range(n)]
    got = {r.host: (r.host_rate, r.trusted) for r in host_rules.verdicts(host_rules.counts(spark.createDataFrame(rows, KINDS))).select("host", "host_rate", "trusted").distinct().collect()}
    m = sum(b for _, b in sizes.values()) / sum(n for n, _ in sizes.values())
    rates = [b / n for n, b in sizes.values()]
    s = min(max(m * (1 - m) / np.var(rates) - 1, 2.0), 1e4)
    for h, (n, b) in sizes.items():
        rate = (b + s * m) / (n + s)
        assert got[h][0] == pytest.approx(rate) and got[h][1] == (rate + math.sqrt(rate * (1 - rate) / (n + s + 1)) < m)
    assert got["d"][1] and not got["b"][1] and not got["c"][1]
    # symmetric: b and the nameless host are credibly worse, c has too few documents to tell
    border = " ".join(f"word{i}" + "#" * (i % 5 < 2) for i in range(80))  # 32 signs in 80 words: within the limits, not within two thirds of them
    docs = spark.createDataFrame([*rows, *[(1000 + i, border, h, "") for i, h in enumerate(sizes)]], KINDS)
    kept = {(r.host, r.id): (r.kept, r.soft_failed, r.borderline, r.distrusted) for r in host_rules.verdicts(host_rules.counts(docs)).collect()}
    assert {h: kept[h, 1000 + i] for i, h in enumerate(sizes)} == {h: (h not in ("b", None), False, True, h in ("b", None)) for h in sizes}
    assert all(k for (h, i), (k, soft, edge, _) in kept.items() if not soft and not edge)


def test_restore_by_brute_force_and_on_long_tokens():
    import itertools
    import time

    m = toxicity.CharModel(toxicity.Counter({"idiot": 5, "moron": 5, "plain": 3, "word": 4, "tool": 2}))

    def cost(text):
        s, total = "^^" + text + "^", 0.0
        for i in range(2, len(s)):
            total += m.cost(s[i - 2], s[i - 1], s[i])
        return total

    for token in ("1d10t", "m0r0n", "w0rd", "p1a!n", "tooool", "x", "@#"):
        ways = toxicity.lattice(token)
        best = min(sum(c for _, c in way) + cost("".join(t for t, _ in way)) for way in itertools.product(*ways))
        got = toxicity.restore(token, m)
        mine = min(sum(c for _, c in way) + cost("".join(t for t, _ in way)) for way in itertools.product(*ways) if "".join(t for t, _ in way) == got)
        assert mine == pytest.approx(best), token
    began = time.process_time()
    half = toxicity.restore("1d10t" * 10_000, m)
    first, began = time.process_time() - began, time.process_time()
    assert len(toxicity.restore("1d10t" * 20_000, m)) >= len(half) == 50_000
    assert time.process_time() - began < 4 * first + 1  # linear


def test_odd_tokens_and_long_ones():
    import re
    import time

    old = re.compile(r"(.)\1\1|[0-9@$!|+€(*#].*[a-zà-ÿ]|[a-zà-ÿ].*[0-9@$!|+€(*#]|[a-zà-ÿ][.\-_'*~`^,][a-zà-ÿ]")
    rng = np.random.default_rng(8)
    for _ in range(3000):
        token = "".join(rng.choice(list("ab1@.-é7(Z*"), rng.integers(1, 9)))
        assert toxicity.odd(token) == bool(old.search(token)), token
    model = toxicity.Toxicity(["you vile fool"] * 3 + ["vile fools here", "vile thing", "good day"], [1, 1, 1, 1, 1, 0])
    began = time.perf_counter()
    for text in ("12" * 500_000, "a" * 1_000_000, "1a" * 20_000, "a b " * 20_000, "a.b" * 20_000):
        assert 0 <= model.score(text) < 0.5
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("seed", range(4))
def test_a_text_beyond_the_bound_is_passed_over(spark, seed):
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 0 else 100)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert sorted(len(r["text"]) for r in common.labelled(docs, labels, "quality", 100, 4900, seed)) == [100] * 49
    assert len(common.labelled(docs, labels, "quality", 100, 1000, seed)) == 10 and len(common.labelled(docs, labels, "quality", 7, 10**6, seed)) == 7
    assert common.fitting([5, 1, 9, 2], 8) == [0, 1, 3] and common.fitting([], 1) == []


def test_toxicity_counts_all_labelled_rows(spark):
    """More labelled rows than the 12,000 of the earlier sample; repeated texts count once, by the first row in seeded order."""
    n = 13_000
    rows = [(i, f"{'vile fellow' if i % 10 == 0 else 'calm fellow'} number{i} Été{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(n)] + [(n + i, "said twice") for i in range(20)] + [(n + 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(n + 21)] + [(None, 1), (n + 3, None)], "doc_id long, toxic int")
    first = {r.doc_id: r.h for r in docs.where("text = 'said twice'").selectExpr("doc_id", "shiftright(xxhash64(doc_id, 7), 1) h").collect()}
    ordered = sorted(rows[:-1], key=lambda r: first.get(r[0], 0))
    want = toxicity.Toxicity([t for _, t in ordered], [int(i % 10 == 0) for i, _ in ordered])
    got = toxicity.fit(docs, labels)
    assert "vile" in got.votes and got.votes == want.votes and got.model.n == want.model.n and got.model.h == want.model.h
    assert got.votes["vile"] == n // 10 / (n // 10 + 1)  # every toxic text counts
    assert toxicity.fit(docs.limit(0), labels).score("vile") < 0.1


def test_labelled_texts_move_once_by_row(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None), (None, "d"), (5, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.training(docs, labels, 7)
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 1), ("c", 0)]
    # of one kind at any size: neither are labels broadcast while they are few, nor are texts grouped by themselves
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "hashpartitioning(text" not in plan
