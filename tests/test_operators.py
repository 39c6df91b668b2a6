import random

import pytest
from pyspark.sql import functions as F

from replicaql.errors import MigrationError, NetworkError, ReplicaError, SourceError, UserSwitchError
from replicaql.operators import changes, entity, integrity, metrics, migrate, orchestrate, paging, reconcile, relations
from replicaql.sources.store import SnapshotStore


def test_replay_equals_a_loop(spark):
    rng = random.Random(5)
    base, ops = {}, []
    for k in range(60):
        if rng.random() < 0.5:
            base[k] = {"a": "1", "b": "2"}
    for seq in range(500):
        kind = rng.choice(["create", "update", "patch", "delete", "update"])
        full = {"a": str(rng.randrange(50)), "b": rng.choice([None, str(rng.randrange(50))])}
        delta = {c: full[c] for c in ("a", "b") if rng.random() < 0.4} or None if kind in ("patch", "update") else None
        if kind == "patch" and not delta:
            delta = {"a": full["a"]}
        ops.append((rng.randrange(80), seq, kind, full, delta))
    want = {k: dict(v) for k, v in base.items()}
    for k, _, kind, full, delta in ops:
        if kind == "delete":
            want.pop(k, None)
        elif kind == "create" or not delta or k not in want:
            want[k] = dict(full)
        else:
            want[k] |= delta
    b = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "id int, a string, b string")
    o = spark.createDataFrame([(k, s, t, (f["a"], f["b"]), d) for k, s, t, f, d in ops], "id int, seq int, type string, full struct<a:string,b:string>, delta map<string,string>")
    got = {r.id: {"a": r.a, "b": r.b} for r in changes.replay(b, o, ["a", "b"]).collect()}
    assert got == want


def test_queue(spark):
    queue = spark.createDataFrame([("x", 1, 0), ("y", 2, 0)], "op_id string, seq int, retry_count int")
    again = changes.enqueue(queue, spark.createDataFrame([("x", 9, 1), ("z", 3, 0)], queue.schema))
    assert sorted(map(tuple, again.collect())) == [("x", 1, 1), ("y", 2, 0), ("z", 3, 0)]
    assert changes.dequeue(again, again.where("op_id = 'x'")).count() == 2
    diffs = changes.diff(spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"], ["v"])
    log = changes.operation_log(diffs, F.lit("u"), F.col("id"), F.lit(0)).orderBy("id").collect()
    assert [(r.type, r.delta) for r in log] == [("update", {"v": "b"}), ("create", None)]
    tries = spark.createDataFrame([(None, None, 0), ("e", True, 2), ("e", True, 3), ("e", False, 0)], "error string, retryable boolean, retry_count int")
    assert [r.outcome for r in changes.outcomes(tries).collect()] == ["synced", "retry", "dead", "dead"]


L = (1, "u", 2, False, 5)
KINDS = [
    (L, (1, "u", 2, False, 9), "none"), (L, (1, "u", 3, False, 1), "bothModified"), (L, (1, "u", 3, True, 1), "deletionConflict"),
    (L, (1, "v", 2, False, 5), "userMismatch"), (None, (1, "v", 2, False, 5), "userMismatch"), (None, (1, "u", 2, False, 5), "none"),
]


@pytest.mark.parametrize("local,remote,kind", KINDS)
def test_conflicts(spark, local, remote, kind):
    schema = "id int, user_id string, version int, is_deleted boolean, modified_at int"
    left, right = spark.createDataFrame([local] if local else [], schema), spark.createDataFrame([remote], schema)
    found = reconcile.matched(left, right, "u")
    row = reconcile.classify(left, right, "u").first()
    assert row.kind == kind
    after = {tuple(r) for r in reconcile.pull(found).collect()}
    assert after == ({remote} if row.action in ("create", "update", "takeRemote") else {local})
    assert reconcile.pull_counts(found).first().conflicts_resolved == (kind != "none")


def test_resolvers(spark):
    s = "struct<version:int,modified_at:int>"
    df = spark.createDataFrame([((1, 1), (2, 0)), ((2, 1), (1, 9)), ((1, 1), (1, 2)), ((1, 2), (1, 2)), (None, (1, 1)), ((1, 1), None), (None, None)], f"l {s}, r {s}")
    run = lambda f: [r[0] for r in df.select(f(F.col("l"), F.col("r"), F.lit("x"))).collect()]
    assert run(reconcile.last_write_wins) == ["takeRemote", "takeLocal", "takeRemote", "takeLocal", "takeRemote", "takeLocal", "abort"]
    assert run(reconcile.local_priority)[4:] == ["takeRemote", "takeLocal", "abort"]
    assert run(reconcile.remote_priority)[3:] == ["takeRemote", "takeRemote", "takeLocal", "abort"]
    assert run(reconcile.merging)[3:] == ["merge", "abort", "abort", "abort"]
    assert run(reconcile.decided(F.lit("takeLocal")))[4] == "abort" and run(reconcile.decided(F.lit(None).cast("string")))[0] == "askUser"


def test_store_and_migration(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t")
    with pytest.raises(SourceError):
        store.read()
    assert store.write(spark.range(3)) == 1
    steps = [migrate.Migration(1, 2, lambda d: d.withColumn("x", F.lit(1))), migrate.Migration(2, 3, lambda d: d.withColumn("y", F.lit(2)))]
    assert migrate.migrate_store(store, steps, 1, 3) == 3 and store.read().columns == ["id", "x", "y"]
    seen = []
    assert migrate.migrate_store(store, [migrate.Migration(3, 4, lambda d: d.select("nope"))], 3, 4, seen.append) == 3 and seen and store.current() == 2
    with pytest.raises(MigrationError):
        migrate.migrate_store(store, steps, 1, 9)
    store.rollback(1)
    assert store.read().columns == ["id"]
    store.clear()
    assert store.versions() == []


def test_orchestration():
    log = []
    r = lambda what: lambda user: log.append((what, user)) or orchestrate.Result(user, synced=1, failed=what == "pull")
    c = orchestrate.Catalog()
    c.register("a", orchestrate.Handler(r("push"), r("pull"), pending=lambda u: 0))
    with pytest.raises(ReplicaError):
        c.register("a", c.handlers["a"])
    assert c.synchronize("u").failed == 0 and [x for x, _ in log] == ["push", "pull"]
    assert c.synchronize("u", "pullThenPush").failed == 1
    assert c.synchronize("u", "pushOnly").skipped == "nothing to push"
    c.pause("u")
    assert c.synchronize("u").skipped == "paused"
    c.resume("u")
    c.online = lambda: False
    assert c.synchronize("u").skipped == "offline"
    c.online = lambda: True
    with pytest.raises(ValueError):
        c.switch_user("u", "")
    c.handlers["a"].pending = lambda u: 1
    with pytest.raises(UserSwitchError):
        c.switch_user("u", "w", "promptIfUnsyncedData")
    c.switch_user("u", "w")
    assert NetworkError("x").retryable


def test_entities_pages_relations(spark):
    e = entity.Entity("p", local_only=("x",), remote_only=("y",), relations={"author": 1})
    df = spark.createDataFrame([(1, 2, 3), (2, None, 4)], "id int, x int, y int")
    assert entity.project(df, e, "remote").columns == ["id", "y"] and entity.project(df, e, "local").columns == ["id", "x"]
    with pytest.raises(ReplicaError):
        e.relation("tags")
    with pytest.raises(ReplicaError):
        entity.Entity("q").relation("tags")
    assert entity.storage_size(df).first().size == len('[{"id":1,"x":2,"y":3},{"id":2,"x":null,"y":4}]')
    p = paging.page(df, ["id"], 2, 1)
    assert (p.total_pages, p.has_more, p.items.first().id) == (2, False, 2)
    assert paging.page(df, ["id"], 9, 1).items.count() == 0
    assert [r.id for r in paging.after(df, "id", 1).collect()] == [2]
    posts = spark.createDataFrame([("post-1", "user-1"), ("post-2", "user-1")], "id string, user_id string")
    tags = spark.createDataFrame([("tag-1",), ("tag-2",)], "id string")
    pivot = spark.createDataFrame([("post-1", "tag-1"), ("post-1", "tag-2"), ("post-1", "tag-1"), ("post-1", None)], "post string, tag string")
    many = relations.ManyToMany("post", "tag")
    assert relations.pairs(posts, many, tags, pivot).count() == 2 and relations.fetch(posts.where("id = 'post-2'"), many, tags, pivot).count() == 0
    users = spark.createDataFrame([("user-1",)], "id string")
    assert relations.fetch(posts, relations.BelongsTo("user_id"), users).count() == 1
    assert relations.pairs(users, relations.HasOne("user_id"), posts, order=("id",)).count() == 1
    assert relations.pairs(users, relations.HasMany("user_id"), posts).count() == 2


def test_links_meet_hashed_keys_unsorted(spark):
    rng = random.Random(3)
    links = [(rng.randrange(40), rng.choice([None, *range(30)])) for _ in range(2_000)]
    parents = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), 4, 4]] + [(None,)], "id long")
    tags = spark.createDataFrame([(i, f"tag {i}") for i in range(0, 50, 3)], "id long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables of any size
    try:
        got = relations.pairs(parents, relations.ManyToMany("post", "tag"), tags, spark.createDataFrame(links, "post long, tag long"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(got.select("parent_key", "name").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [x for x in plan.split("\n") if "LeftSemi" in x and "ShuffledHashJoin" in x] and not [x for x in plan.split("\n") if "LeftSemi" in x and "SortMergeJoin" in x]
    assert rows == sorted({(p, f"tag {t}") for p, t in links if p % 2 == 0 and t is not None and t % 3 == 0})


def test_hash_and_metrics(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, v string")
    one, two = (integrity.content_hash(x, ["id", "v"], "id").first().hash for x in (df, df.orderBy("id")))
    assert one == two and len(one) == 64
    assert integrity.content_hash(df.limit(0), ["id", "v"], "id").first().hash.startswith("4f53cda1")
    assert integrity.rolling_hash(df, ["id", "v"]).first() == integrity.rolling_hash(df.orderBy("v"), ["id", "v"]).first()
    meta = spark.createDataFrame([("u", "h", 1), ("v", "h", 1)], "user_id string, data_hash string, last_sync_time int")
    assert {r.user_id: r.full for r in integrity.needs_full_sync(meta, meta.where("user_id = 'u'")).collect()} == {"u": False, "v": True}
    parts = spark.createDataFrame([(True, True, False)], "reachable boolean, local_ok boolean, remote_ok boolean")
    assert metrics.health(parts).first().health == "degraded"
    switch = metrics.combined_switch(spark.createDataFrame([(True, 2, None), (False, 1, "x")], "success boolean, handled int, error string")).first()
    assert (switch.success, switch.handled, switch.errors) == (False, 3, "x")
