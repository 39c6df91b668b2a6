"""Hash trees against nested hashes, drift against row comparison, replays of hot keys, metadata of two replicas."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from replicaql.errors import SourceError
from replicaql.operators import changes, hashtree, integrity
from replicaql.sources import scratch


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _root(rows, depth):
    """rows: (key, values by name); the tree as its definition says, one level at a time."""
    level = {}
    for k, v in sorted(rows):
        level.setdefault(_sha(str(k))[:depth], []).append(_sha(json.dumps(v, separators=(",", ":"))))
    level = {p: _sha("".join(d)) for p, d in level.items()}
    for digits in range(depth - 1, -1, -1):
        up = {}
        for p, h in sorted(level.items()):
            up.setdefault(p[:digits], []).append(f"{p}:{h}")
        level = {p: _sha(",".join(c)) for p, c in up.items()}
    return level.get("")


def _table(spark, rows):
    return spark.createDataFrame(rows, "user_id string, id long, v string")


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_and_drift(spark, depth):
    rng = random.Random(depth)
    local = [(rng.choice(["u", "v", "v", None]), i, rng.choice([None, "a", "b"])) for i in range(400)]
    remote = [(u, i, "changed" if i % 67 == 0 else v) for u, i, v in local if i % 71] + [("new", 900, "x"), ("u", 901, None)]
    a, b = _table(spark, local), _table(spark, remote).repartition(7)
    args = (["id", "v"], "id", ["user_id"], depth)
    for df, rows in ((a, local), (b, remote)):
        got = {r.user_id: r.hash for r in hashtree.roots(df, *args).collect()}
        assert got == {u: _root([(i, {"id": i, "v": v}) for w, i, v in rows if w == u], depth) for u in {r[0] for r in rows}}
    trees = [hashtree.tree(df, *args) for df in (a, b)]
    assert {r.level for r in trees[0].select("level").distinct().collect()} == set(range(depth + 1))
    x, y = ({(u, i): v for u, i, v in rows} for rows in (local, remote))
    want = {(u, _sha(str(i))[:depth]) for u, i in x.keys() | y.keys() if (u, i) not in x or (u, i) not in y or x[u, i] != y[u, i]}
    ranges = hashtree.differing(*trees, ["user_id"], depth)
    assert {tuple(r) for r in ranges.collect()} == want
    sent = {(r.user_id, r.id) for r in hashtree.rows_in(a, ranges, "id", ["user_id"], depth).collect()}
    assert sent == {(u, i) for u, i in x if (u, _sha(str(i))[:depth]) in want}
    assert hashtree.differing(trees[0], trees[0], ["user_id"], depth).count() == 0


def test_depth():
    assert [hashtree.leaf_depth(n) for n in (0, 4096, 4097, 65536, 65537, 10**12)] == [0, 0, 1, 1, 2, 7]


def test_no_rows(spark):
    empty = _table(spark, [])
    assert hashtree.roots(empty, ["v"], "id", ["user_id"]).count() == 0
    ranges = hashtree.differing(hashtree.tree(empty, ["v"], "id", [], 1), hashtree.tree(_table(spark, [("u", 1, "a")]), ["v"], "id", [], 1), [], 1)
    assert [r.prefix for r in ranges.collect()] == [_sha("1")[:1]]


def test_metadata_of_two_replicas(spark, tmp_path):
    rows = _table(spark, [("u", 1, "a"), ("u", 2, None), ("w", 3, "c")])
    for now, df in ((1, rows), (2, rows.where("id <> 2"))):
        integrity.save_metadata(integrity.hashed_metadata({"t": (df, ["id", "v"], "id")}, F.lit(now)), f"{tmp_path}/a", *([f"{tmp_path}/b"] if now == 1 else []))
    a, b = (integrity.saved_metadata(spark, f"{tmp_path}/{x}") for x in "ab")
    seen = {r.user_id: r.entity_counts["t"] for r in a.collect()}
    assert seen["u"].n == 1 and seen["u"].hash == _root([(1, {"id": 1, "v": "a"})], 2)
    assert {r.user_id: r.full for r in integrity.needs_full_sync(a, b).collect()} == {"u": True, "w": False}


def _ops(rng, n, keys, hot):
    out = []
    for seq in range(n):
        kind = rng.choice(["create", "update", "patch", "delete", "patch", "patch"])
        full = {"a": str(rng.randrange(50)), "b": rng.choice([None, str(rng.randrange(50))])}
        delta = {c: full[c] for c in "ab" if rng.random() < 0.4} or None if kind in ("patch", "update") else None
        out.append((-1 if rng.random() < hot else rng.randrange(keys), seq * 3 - 100, kind, full, {"a": full["a"]} if kind == "patch" and not delta else delta))
    return out


@pytest.mark.parametrize("hot,limit,parts", [(0.5, 20, 8), (0.9, 1, 64), (0.0, 3, 2)])
def test_replay_of_a_hot_key(spark, hot, limit, parts):
    """Half of the log is one key's: its operations are cut into runs, and the rows are those of a loop."""
    rng = random.Random(parts)
    base = {k: {"a": "1", "b": "2"} for k in range(-1, 40, 2)}
    ops, want = _ops(rng, 600, 40, hot), {k: dict(v) for k, v in base.items()}
    for k, _, kind, full, delta in ops:
        if kind == "delete":
            want.pop(k, None)
        elif kind == "create" or not delta or k not in want:
            want[k] = dict(full)
        else:
            want[k] |= delta
    rng.shuffle(ops)
    b = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "id int, a string, b string")
    o = spark.createDataFrame([(k, s, t, (f["a"], f["b"]), d) for k, s, t, f, d in ops], "id int, seq int, type string, full struct<a:string,b:string>, delta map<string,string>")
    got = {r.id: {"a": r.a, "b": r.b} for r in changes.replay(b, o, ["a", "b"], limit=limit, parts=parts).collect()}
    assert got == want
    cut = changes.runs(o, ["a", "b"], limit=limit, parts=parts).groupBy("id").count().agg(F.max("count")).first()[0]
    assert 2 <= cut <= parts


def test_replay_of_nothing(spark):
    b = spark.createDataFrame([(1, "x")], "id int, a string")
    o = spark.createDataFrame([], "id int, seq int, type string, full struct<a:string>, delta map<string,string>")
    assert [tuple(r) for r in changes.replay(b, o, ["a"]).collect()] == [(1, "x")] and changes.replay(b.limit(0), o, ["a"]).count() == 0


def test_shared_folder(spark):
    class Session:
        def __init__(self, **known):
            self.conf = known

    assert scratch.fresh(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    with pytest.raises(SourceError, match="spark.checkpoint.dir"):
        scratch.folder(Session(**{"spark.master": "yarn"}))


def test_digests_move_as_bytes(spark):
    """32 bytes a range in the written levels, which hold the roots that roots() gives in hex."""
    rows = _table(spark, [("u" if i % 3 else None, i, str(i % 7)) for i in range(300)])
    args = (["id", "v"], "id", ["user_id"], 2)
    tree = hashtree.tree(rows, *args)
    assert {r.n for r in tree.selectExpr("octet_length(hash) n").distinct().collect()} == {32}
    assert tree.where("level = 2").count() == rows.selectExpr("user_id", "substr(sha2(string(id), 256), 1, 2) p").distinct().count()
    assert {r.user_id: bytes(r.hash).hex() for r in tree.where("level = 0").collect()} == {r.user_id: r.hash for r in hashtree.roots(rows, *args).collect()}
