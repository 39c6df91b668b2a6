"""What writes must not lose: conflicts, other users' rows, repeated keys, missing rows, concurrent commits."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from replicaql.functions import scalars
from replicaql.operators import changes, entity, orchestrate, paging, reconcile, results
from replicaql.sources.store import SnapshotStore

KINDS = "id long, user_id string, amt long, version long, is_deleted boolean, modified_at long"


def _replicas(spark):
    local = spark.createDataFrame([(1, "u", 10, 1, False, 0), (1, "w", 99, 1, False, 0), (2, "u", 20, 1, False, 0), (3, "w", 30, 1, False, 0)], KINDS)
    remote = spark.createDataFrame([(1, "u", 11, 2, False, 0), (4, "u", 40, 1, False, 0)], KINDS)
    return local, remote


def test_pull_keeps_other_users_rows(spark):
    local, remote = _replicas(spark)
    rows = reconcile.pull(reconcile.matched(local, remote, "u")).collect()
    assert sorted((r.user_id, r.id, r.amt) for r in rows) == [("u", 1, 11), ("u", 2, 20), ("u", 4, 40), ("w", 1, 99), ("w", 3, 30)]


def test_pull_without_a_merge_function_fails(spark):
    local, remote = _replicas(spark)
    found = reconcile.matched(local, remote, "u", resolver=reconcile.merging)
    with pytest.raises(PySparkException, match="no merge function"):
        reconcile.pull(found).select("id").collect()
    merged = reconcile.pull(found, lambda l, r: [r["id"], r["user_id"], l["amt"] + r["amt"], r["version"], r["is_deleted"], r["modified_at"]])
    assert {r.amt for r in merged.where("id = 1 and user_id = 'u'").collect()} == {21}


def test_pull_of_users_that_share_ids(spark):
    """Each remote row meets its own user's row, or, if there is none, is a mismatch to the smallest other user's."""
    local = spark.createDataFrame([(1, "u", 10, 1, False, 0), (1, "w", 99, 1, False, 0), (2, "v", 20, 1, False, 0), (2, "w", 21, 5, False, 0), (7, None, 7, 1, False, 0)], KINDS)
    remote = spark.createDataFrame([(1, "u", 11, 1, False, 0), (2, "u", 22, 2, False, 0), (3, "w", 33, 1, False, 0), (7, None, 8, 2, False, 0)], KINDS)
    found = reconcile.matched(local, remote, each=True)
    seen = {(r.r.id, r.r.user_id): (r.l.user_id if r.l else None, r.kind, r.action) for r in found.where("r is not null").collect()}
    assert seen == {(1, "u"): ("u", "none", "update"), (2, "u"): ("v", "userMismatch", "takeRemote"), (3, "w"): (None, "none", "create"), (7, None): (None, "bothModified", "takeRemote")}
    rows = reconcile.pull(found).collect()
    assert sorted(((r.user_id, r.id, r.amt) for r in rows), key=str) == sorted([("u", 1, 11), ("w", 1, 99), ("v", 2, 20), ("w", 2, 21), ("u", 2, 22), ("w", 3, 33), (None, 7, 8)], key=str)
    with pytest.raises(PySparkException, match="a remote row twice for u, 1"):
        reconcile.pull(reconcile.matched(local, remote.union(remote.limit(1)), each=True)).collect()


def test_observed_pull(spark, tmp_path):
    local, remote = _replicas(spark)
    found = reconcile.matched(local, remote.union(spark.createDataFrame([(2, "u", 5, 1, True, 0)], KINDS)), "u")
    counts = reconcile.observed_pull(found, lambda df: df.write.parquet(f"{tmp_path}/after"))
    assert counts == reconcile.pull_counts(found).first().asDict()
    assert (counts["conflicts_resolved"], counts["written"], counts["deletions"], counts["modifications"], counts["pulled"]) == (2, 2, 1, 1, 3)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/after").collect())) == sorted(map(tuple, reconcile.pull(found).collect()))
    one = {"user_id": "u", "synced": counts["written"], "failed": 0, "conflicts_resolved": counts["conflicts_resolved"], "bytes_pulled": counts["bytes_pulled"]}
    results.append(spark, f"{tmp_path}/results", one, 1)
    results.append(spark, f"{tmp_path}/results", one | {"synced": 9}, 2)
    results.append(spark, f"{tmp_path}/results", {"user_id": "w", "skip_reason": "offline"}, 3)
    last = {r.user_id: r for r in results.last(spark, f"{tmp_path}/results").collect()}
    assert last["u"].synced == 9 and last["u"].total_bytes_pulled == 2 * counts["bytes_pulled"] and (last["w"].was_skipped, last["w"].skip_reason) == (True, "offline")


def test_push_writes_nothing_without_an_operation(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, s string, n long")
    rows = spark.createDataFrame([(1, "a", 77), (2, "c", 88)], "id long, s string, n long")
    saved, log = changes.push(base, rows, ["id"], ["s"], F.lit("u"), F.col("id"), F.lit(0))
    assert sorted(map(tuple, saved.collect())) == [(1, "a", 1), (2, "c", 88)] and [r.id for r in log.collect()] == [2]
    up = lambda df: df.withColumn("s", F.upper("s"))
    for source, force, n in (("remote", False, 0), ("remote", True, 2), ("local", False, 2)):
        saved, log = changes.push(base, rows, ["id"], ["s"], F.lit("u"), F.col("id"), F.lit(0), source, force, [up])
        assert sorted(r.s for r in saved.collect()) == ["A", "C"] and log.count() == n
    with pytest.raises(PySparkException, match="an old row twice"):
        changes.diff(base.union(base), rows, ["id"], ["s"]).collect()


def test_repeated_and_missing_keys_fail(spark):
    base = spark.createDataFrame([(1, "a")], "id long, s string")
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "id long, s string")
    with pytest.raises(PySparkException, match="twice"):
        changes.upsert(base, twice, ["id"]).collect()
    assert changes.upsert(base, twice, ["id"], F.col("s")).where("id = 2").first().s == "y"
    deltas = spark.createDataFrame([(5, {"s": "z"})], "id long, delta map<string,string>")
    with pytest.raises(PySparkException, match="no row to patch"):
        changes.patch(base, deltas, ["id"], ["s"]).collect()
    assert changes.patch(base, deltas, ["id"], ["s"], missing="ignore").collect() == base.collect()
    assert {r.id: r.went for r in changes.deleted(base, spark.createDataFrame([(1,), (9,)], "id long"), ["id"]).collect()} == {1: True, 9: False}


def test_push_logs_what_a_replay_needs(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, s string, n long")
    rows = spark.createDataFrame([(1, "a", 1), (2, "c", 2), (3, "d", 3)], "id long, s string, n long")
    saved, log = changes.push(base, rows, ["id"], ["s", "n"], F.lit("u"), F.col("id"), F.lit(0))
    assert sorted((r.id, r.type) for r in log.collect()) == [(2, "update"), (3, "create")]
    ops = log.select("id", "seq", "type", "full", "delta")
    assert sorted(changes.replay(base, ops, ["s", "n"]).collect()) == sorted(saved.collect())


def test_second_writer_does_not_overwrite(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t")
    store.write(spark.range(1))
    other = SnapshotStore(spark, f"file://{tmp_path}/t")
    ran = []

    def change(df):
        if not ran:  # another writer commits in between
            ran.append(other.write(df.union(spark.range(10, 11))))
        return df.union(spark.range(20, 21))

    assert store.transaction(change) == 3 and ran == [2]
    assert sorted(r.id for r in store.read().collect()) == [0, 10, 20]
    assert store.versions() == [1, 2, 3] and store.read(1).count() == 1


def test_batches():
    def run(x):
        if x == 3:
            raise ValueError(x)
        return x

    done, failed = orchestrate.in_batches(range(6), run, 2, fail_fast=False)
    assert done == [0, 1, 2, 4, 5] and [x for x, _ in failed] == [3]
    with pytest.raises(ValueError):
        orchestrate.in_batches(range(6), run, 2)


def test_cursor_and_cases(spark):
    df = spark.createDataFrame([(i % 3, i, {"innerName": i}) for i in range(10)], "a long, b long, someMap struct<innerName:long>")
    seen, cursor = [], None
    while True:
        rows, cursor = paging.cursor_page(df, ["a", "b"], cursor, 4, descending=[True, False])
        seen += [(r.a, r.b) for r in rows]
        if cursor is None:
            break
    assert seen == sorted(((i % 3, i) for i in range(10)), key=lambda x: (-x[0], x[1]))
    assert scalars.deep_columns(df).schema["some_map"].dataType.names == ["inner_name"]
    steps = entity.Entity("t", before_save=(lambda d: d.withColumn("b", F.col("b") + 1),), after_fetch=(lambda d: d.where("b > 9"),))
    assert entity.fetched(entity.saved(df, steps), steps).count() == 1


def test_a_commit_that_died(spark, tmp_path, monkeypatch):
    """An empty marker is no version: readers pass over it, and once it is old the next writer takes its place."""
    store = SnapshotStore(spark, f"file://{tmp_path}/t")
    store.write(spark.range(1))
    (tmp_path / "t/_commits/2").write_text("")
    assert store.versions() == [1] and store.read().count() == 1 and store.write(spark.range(3)) == 3
    (tmp_path / "t/_commits/4").write_text("")
    monkeypatch.setattr("replicaql.sources.store.UNDONE", -1)
    assert store.transaction(lambda df: df.union(spark.range(10, 11))) == 4 and store.read().count() == 4


def test_pause_twice():
    c = orchestrate.Catalog()
    c.pause("u")
    c.pause("u")
    c.resume("u")
    assert c.status["u"] == "idle"


def test_store_by_user(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(x, "user_id string, id long")
    store.write(rows(("u", 1), ("u", 2), ("w", 1), (None, 5)))
    store.replace_user(rows(("u", 9)), "u")
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted([("u", 9), ("w", 1), (None, 5)], key=str)
    assert sorted(map(tuple, changes.clear_user(store.read(), "u").collect()), key=str) == sorted([("w", 1), (None, 5)], key=str)
