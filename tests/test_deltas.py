"""Streams whose state ends, live queries by deltas, external changes once only, live relations: against loops and re-evaluation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from replicaql.operators.relations import BelongsTo, HasMany, HasOne, ManyToMany
from replicaql.plans.compiler import apply
from replicaql.plans.model import QueryBuilder
from replicaql.streaming import deltas, live
from replicaql.streaming.external import ExternalChanges, LiveRelation, Side
from replicaql.streaming.sink import Version, once

ROW = "id long, grp string, v long"
CHANGE = f"{ROW}, type string, seq long"


def _files(spark, rows, kinds, path, cuts, first=0):
    """rows in files of one batch each, in order of their names."""
    for n, part in enumerate(cuts):
        spark.createDataFrame(rows[part[0] : part[1]], kinds).coalesce(1).write.parquet(f"{path}/{first + n:03d}")


def _stream(spark, path, kinds):
    schema = spark.createDataFrame([], kinds).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def _cuts(n, k):
    at = [round(i * n / k) for i in range(k + 1)]
    return list(zip(at, at[1:]))


def _random_changes(rng, n, keys):
    return [(rng.randrange(keys), rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.choice(["create", "update", "update", "delete"]), seq) for seq in range(n)]


def test_suppression_state_ends(spark, tmp_path):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = sorted([(i, rng.randrange(6), start + dt.timedelta(seconds=rng.randrange(3000) / 10)) for i in range(300)], key=lambda r: (r[2], r[0]))
    rows += [(1000, 99, start + dt.timedelta(hours=2)), (1001, None, start + dt.timedelta(hours=2)), (1002, 99, start + dt.timedelta(hours=2, seconds=4)), (1003, 99, start + dt.timedelta(hours=2, seconds=6)), (1004, 99, None)]
    kinds = "event_id long, user_id long, ts timestamp"
    # no run of equal times is cut, and the late files hold one key only
    _files(spark, rows, kinds, f"{tmp_path}/in", [(0, 90), (90, 91), (91, 220), (220, 300), (300, 302), (302, 305)])
    kept, rows_held = [], []
    with deltas.rocksdb(spark):
        stream = live.suppress_stream(_stream(spark, f"{tmp_path}/in", kinds), "user_id", "ts", 5.0, ["event_id"])
        q = stream.writeStream.foreachBatch(lambda df, n: kept.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        rows_held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    events = spark.createDataFrame(rows, kinds).where("ts is not null")
    assert sorted(r.event_id for r in kept) == sorted(r.event_id for r in live.suppress(events, "user_id", "ts", ["event_id"]).collect())
    assert max(rows_held) == 6 and rows_held[-1] <= 2  # the six keys of the first hours are gone


@pytest.mark.parametrize("seed", [1, 2])
def test_live_queries_equal_re_evaluation(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = [(k, rng.choice(["a", "b"]), rng.randrange(30)) for k in range(0, 25, 2)]
    log = _random_changes(rng, 60, 25)
    _files(spark, log, CHANGE, f"{tmp_path}/in", _cuts(60, 6))
    start = spark.createDataFrame(base, ROW)
    whole = spark.createDataFrame(log, CHANGE)
    query = QueryBuilder().where("v", ge=3).order_by("v", True).limit(4).offset(1).build()

    def after(number):
        return live.apply_changes(start, whole.where(F.col("seq") < (number + 1) * 10), "id", ["seq"])

    counts, tops = {}, {}
    with deltas.rocksdb(spark):
        for name in ("counts", "all", "top"):
            rows = deltas.signed(_stream(spark, f"{tmp_path}/in", CHANGE), "id", ["id", "grp", "v"], "seq", base=start)
            if name == "top":
                q = deltas.live_top(rows, query, ["id"], f"{tmp_path}/t", f"{tmp_path}/cp-{name}", after, start, lambda df, n, anew: tops.setdefault(n, (df.collect(), anew)))
            elif name == "all":
                q = deltas.live_counts(rows, f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}", (), F.col("v") > 5, start.where("v > 5").agg(F.count("*").alias("n")), lambda df, n: counts.setdefault((n, "all"), df.collect()))
            else:
                q = deltas.live_counts(rows, f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}", ["grp"], None, start.groupBy("grp").agg(F.count("*").alias("n")), lambda df, n: counts.setdefault((n, "grp"), df.collect()))
            q.awaitTermination()
    assert len(tops) == 6
    for n in range(6):
        now = after(n)
        assert sorted(map(tuple, counts[n, "grp"]), key=str) == sorted(map(tuple, now.groupBy("grp").count().collect()), key=str)
        assert [r.n for r in counts[n, "all"]] == [now.where("v > 5").count()]
        assert tops[n][0] == apply(now, query, ("id",)).collect()
    assert {anew for _, anew in tops.values()} == {True, False}


def test_versions_of_repeated_batches(spark, tmp_path):
    schema = spark.createDataFrame([], "g string, n long").schema
    v = Version(spark, f"{tmp_path}/v", schema)
    rows = lambda *x: spark.createDataFrame(x, schema)
    v.write(rows(("a", 1)), -1)
    v.write(rows(), 0)
    assert v.read().count() == 0 and v.read(0).count() == 1
    v.write(rows(("b", 2), (None, 3)), 1)
    v.write(rows(("b", 2), (None, 3)), 1)
    assert sorted(map(tuple, v.read().collect()), key=str) == sorted([("b", 2), (None, 3)], key=str) and v.read(1).count() == 0
    once(rows(("x", 1)), f"{tmp_path}/o", 3)
    once(rows(("y", 1)), f"{tmp_path}/o", 3)
    assert [r.g for r in spark.read.parquet(f"{tmp_path}/o").collect()] == ["y"]


@pytest.mark.parametrize("fails", [None, "changes", "queue"])
def test_external_changes_once(spark, tmp_path, fails):
    """A batch that dies after either of its writes and is repeated leaves what one that doesn't die leaves."""
    rng = random.Random(3)
    kinds = f"{CHANGE}, source_id string"
    base = [(k, "a", k) for k in range(8)]
    log = [(*c, rng.choice(["local", "remote"])) for c in _random_changes(rng, 40, 12)] + [(5, "z", 5, "update", 100, "local"), (5, "z", 5, "update", 101, "local")]
    _files(spark, log, kinds, f"{tmp_path}/in", [(0, 15), (15, 30), (30, 42)])
    table = ExternalChanges(f"{tmp_path}/t", spark.createDataFrame(base, ROW), "id", ["id", "grp", "v"], "seq")
    stream = _stream(spark, f"{tmp_path}/in", kinds)
    if fails:
        broken = ExternalChanges(f"{tmp_path}/t", table.base, "id", table.columns, "seq")
        whole, made = broken.batch, broken._operations

        def die(df, number):
            if number == 1 and fails == "changes":
                broken._operations = lambda n: made(n).where(F.raise_error(F.lit("killed")).isNull())
            whole(df, number)
            if number == 1:
                raise RuntimeError("killed")

        broken.batch = die
        with pytest.raises(Exception, match="killed"):
            broken.start(stream, f"{tmp_path}/cp").awaitTermination()
    table.start(stream, f"{tmp_path}/cp").awaitTermination()
    rows, ops = {k: (k, g, v) for k, g, v in base}, []
    for k, g, v, kind, seq, source in log:
        there = rows.get(k)
        if kind == "delete":
            rows.pop(k, None)
            continue
        rows[k] = (k, g, v)
        if source == "local" and there != rows[k]:
            ops.append((k, "update" if there else "create", seq, rows[k]))
    assert sorted(map(tuple, table.rows().collect())) == sorted(rows.values())
    got = table.queue().collect()
    assert sorted((r.id, r.type, r.seq, tuple(r.full)) for r in got) == sorted(ops)
    assert all((r.delta is None) == (r.type == "create") for r in got)


def _side(spark, path, base, kinds, log):
    _files(spark, log, f"{kinds}, type string, ts long", path, [(n, n + 1) for n in range(len(log))])
    names = tuple(c.split()[0] for c in kinds.split(", "))
    return Side(spark.createDataFrame(base, kinds), _stream(spark, path, f"{kinds}, type string, ts long"), "id", names)


def test_live_many_to_many(spark, tmp_path):
    """Posts and tags: the pivot changes, then a tag, then a post; each batch evaluates the posts it touches."""
    posts, tags = [("p1", 1), ("p2", 2), ("p3", 3)], [("t1", "Flutter"), ("t2", "Dart")]
    pivot = [("x1", "p1", "t1"), ("x2", "p1", "t2"), ("x3", "p2", "t1")]
    sides = {
        "parents": _side(spark, f"{tmp_path}/p", posts, "id string, n long", [("p3", 3, "update", 1), ("p2", 9, "delete", 1)]),
        "related": _side(spark, f"{tmp_path}/r", tags, "id string, name string", [("t2", "dart", "update", 1), ("t9", "new", "create", 1)]),
        "pivot": _side(spark, f"{tmp_path}/x", pivot, "id string, post string, tag string", [("x3", "p2", "t2", "update", 1), ("x1", "p1", "t1", "delete", 1)]),
    }
    seen = {}
    rel = LiveRelation(f"{tmp_path}/state", ManyToMany("post", "tag"), sides)
    q = rel.start(f"{tmp_path}/cp", lambda parents, rows, n: seen.setdefault(n, ({r.id for r in parents.collect()}, sorted((r.parent_key, r.name) for r in rows.collect()))))
    q.awaitTermination()
    assert seen[-1] == ({"p1", "p2", "p3"}, [("p1", "Dart"), ("p1", "Flutter"), ("p2", "Flutter")])
    # batch 0: p3 itself, t2 (of p1, and of p2 by the pivot's new row), x3 (of p2)
    assert seen[0] == ({"p1", "p2", "p3"}, [("p1", "Flutter"), ("p1", "dart"), ("p2", "dart")])
    # batch 1: p2 goes, t9 belongs to nobody, x1 leaves p1
    assert seen[1] == ({"p1"}, [("p1", "dart")])


@pytest.mark.parametrize("relation,parents,related", [
    (HasMany("owner"), [("u1", None), ("u2", None), ("u3", None)], [("c1", "u1"), ("c2", "u2")]),
    (HasOne("owner"), [("u1", None), ("u2", None), ("u3", None)], [("c1", "u1"), ("c2", "u2")]),
    (BelongsTo("owner"), [("c1", "u1"), ("c2", "u2"), ("c3", None)], [("u1", None), ("u2", None), ("u3", None)]),
])
def test_live_relations(spark, tmp_path, relation, parents, related):
    """Moves of a row touch the parents it had and has; others are left alone."""
    kinds = "id string, owner string"
    moves = [("c2", "u3", "update", 1)]
    p, r = (moves, []) if isinstance(relation, BelongsTo) else ([], moves)
    sides = {"parents": _side(spark, f"{tmp_path}/p", parents, kinds, p or [("none", None, "delete", 1)]), "related": _side(spark, f"{tmp_path}/r", related, kinds, r or [("none", None, "delete", 1)])}
    seen = {}
    LiveRelation(f"{tmp_path}/state", relation, sides).start(f"{tmp_path}/cp", lambda a, rows, n: seen.setdefault(n, (sorted(x.id for x in a.collect()), sorted((x.parent_key, x.id) for x in rows.collect())))).awaitTermination()
    if isinstance(relation, BelongsTo):
        assert seen[-1][1] == [("c1", "u1"), ("c2", "u2")] and seen[0] == (["c2"], [("c2", "u3")])
    else:
        assert seen[-1][1] == [("u1", "c1"), ("u2", "c2")] and seen[0] == (["u2", "u3"], [("u3", "c2")])
