"""Write-then-sync, resolutions, retries of the caller's own, typed builders and what must be there."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from replicaql.errors import EntityNotFound
from replicaql.functions import scalars
from replicaql.operators import changes, entity, metrics, reconcile, writesync
from replicaql.plans.compiler import apply
from replicaql.plans.model import Filter, FieldQuery, Op, Query, Sort
from replicaql.sources.store import SnapshotStore

KINDS = "id long, user_id string, amt long, version long, is_deleted boolean, modified_at long"


def _frames(spark):
    local = spark.createDataFrame([(1, "u", 10, 1, False, 0), (1, "w", 99, 1, False, 0), (2, "u", 20, 1, False, 0)], KINDS)
    remote = spark.createDataFrame([(1, "u", 10, 1, True, 0), (1, "w", 98, 3, False, 9), (2, "u", 20, 1, False, 0), (5, "u", 50, 1, False, 0)], KINDS)
    return local, remote


def _rows(df):
    return sorted((r.user_id, r.id, r.amt, r.version, r.is_deleted) for r in df.collect())


def test_push_and_sync(spark):
    """An update goes out as its changes, so the remote row keeps what they leave alone; users who share an id stay apart."""
    local, remote = _frames(spark)
    rows = spark.createDataFrame([(1, "u", 11, 2, False, 1), (2, "u", 20, 1, False, 0), (7, "w", 70, 1, False, 0)], KINDS)
    done = writesync.push_and_sync(local, remote, rows, F.col("id"), F.lit(0), resolver=reconcile.local_priority)
    assert sorted((r.user_id, r.id, r.type) for r in done.log.collect()) == [("u", 1, "update"), ("w", 7, "create")]
    assert _rows(done.remote) == [("u", 1, 11, 2, True), ("u", 2, 20, 1, False), ("u", 5, 50, 1, False), ("w", 1, 98, 3, False), ("w", 7, 70, 1, False)]
    assert _rows(done.local) == [("u", 1, 11, 2, False), ("u", 2, 20, 1, False), ("u", 5, 50, 1, False), ("w", 1, 99, 1, False), ("w", 7, 70, 1, False)]
    counts = reconcile.pull_counts(done.found).first()
    assert (counts.deletions, counts.modifications, counts.pulled) == (1, 1, 5)
    again = writesync.push_and_sync(done.local, done.remote, rows, F.col("id"), F.lit(0))
    assert again.log.count() == 0 and _rows(again.remote) == _rows(done.remote)


def test_delete_and_sync(spark):
    local, remote = _frames(spark)
    keys = spark.createDataFrame([("w", 1), ("u", 5), ("u", 404)], "user_id string, id long")
    done = writesync.delete_and_sync(local, remote, keys, F.col("id"), F.lit(0))
    assert [(r.user_id, r.id, r.type) for r in done.log.collect()] == [("w", 1, "delete")]
    assert [x[:2] for x in _rows(done.remote)] == [("u", 1), ("u", 2), ("u", 5)] == [x[:2] for x in _rows(done.local)]
    empty = writesync.delete_and_sync(local.limit(0), remote.limit(0), keys, F.col("id"), F.lit(0))
    assert empty.local.count() == empty.remote.count() == 0


def test_resolutions(spark):
    local, remote = _frames(spark)
    found = reconcile.matched(local, remote, each=True, resolver=lambda l, r, k: F.when(k == reconcile.DELETION, reconcile.ASK).otherwise(reconcile.ABORT))
    got = {r.user_id: r.resolution for r in reconcile.resolutions(found).collect()}
    assert got["u"].strategy == "askUser" and got["u"].requires_user_input and got["u"].message == "deletionConflict of 1 needs a choice" and got["u"].data is None
    assert got["w"].strategy == "abort" and not got["w"].requires_user_input and got["w"].message == "bothModified of 1 has no side to take"
    taken = reconcile.resolutions(reconcile.matched(local, remote, each=True, resolver=reconcile.remote_priority)).where("user_id = 'w'").first().resolution
    assert (taken.strategy, taken.data.amt, taken.message) == ("takeRemote", 98, None)


def test_own_retries(spark):
    tries = spark.createDataFrame([("timeout", 0), ("denied", 0), ("timeout", 3), (None, 1), ("timeout", 1)], "error string, retry_count int")
    got = changes.outcomes(tries, 3, F.col("error") == "timeout", lambda n: F.get(F.array(F.lit(7), F.lit(-5)), n - 1)).collect()
    assert [(r.outcome, r.delay_ms) for r in got] == [("retry", 7), ("dead", None), ("dead", None), ("synced", None), ("retry", 0)]


class Tasks(FieldQuery):
    fields = {"title": str, "size": (int, float), "tags": str}

    def tagged(self, tag):
        return self.where("tags", array_contains=tag)


def test_typed_builder(spark):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["x", "y"]), ("c", 3, ["y"])], "title string, size long, tags array<string>")
    q = Tasks().tagged("x").where("size", ge=2).order_by("title").build()
    assert [r.title for r in apply(df, q).collect()] == ["b"]
    for wrong in (lambda: Tasks().where("colour", eq="red"), lambda: Tasks().order_by("colour"), lambda: Tasks().where_null("colour"), lambda: Tasks().any_of([Filter("title", Op.EQ, "a"), Filter("colour", Op.NULL)])):
        with pytest.raises(AttributeError, match="no field colour"):
            wrong()
    with pytest.raises(TypeError, match="not compared with int"):
        Tasks().where("title", is_in=["a", 3])
    q = Query((Filter("title", Op.EQ, "a"),), (Sort("title"),), 5, 2)
    assert q.replace(limit=9) == Query(q.filters, q.sorting, 9, 2) and q.replace(limit=None, offset=1).limit == 5
    assert Tasks().where("size", gt=1).limit(3).reset().build() == Query()


def test_rows_that_must_be_there(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    assert entity.read(df, 2).s == "b"
    with pytest.raises(EntityNotFound, match="no row with id 3"):
        entity.read(df, 3)
    assert {r.s for r in entity.required(df, spark.createDataFrame([(1,), (2,), (1,)], "id long")).collect()} == {"a", "b"}
    with pytest.raises(PySparkException, match="no row with id 9"):
        entity.required(df, spark.createDataFrame([(1,), (9,)], "id long")).collect()


def test_users_rows_replaced_and_cleared(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", 1), (2, "w", 2), (3, None, 3)], "id long, user_id string, n long")
    assert {r.id for r in changes.clear_user(df, "u").collect()} == {2, 3} and {r.id for r in changes.clear_user(df, None).collect()} == {1, 2}
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.write(df)
    store.replace_user(spark.createDataFrame([(9, "u", 9), (8, "u", 8)], df.schema), "u")
    assert sorted(r.id for r in store.read().collect()) == [2, 3, 8, 9] and store.read(1).count() == 3


def test_durations_and_ids(spark):
    texts = {0: "0µs", 999: "999µs", 1_000: "1ms", 61_000_000: "1m 1s", 3_600_000_000: "1h 0m", 93_600_000_000: "1d 2h", 86_399_999_999: "23h 59m"}
    df = spark.createDataFrame([(k,) for k in texts], "us long").select("us", scalars.duration_text(F.col("us")).alias("t"), scalars.new_id().alias("i"))
    rows = df.collect()
    assert {r.us: r.t for r in rows} == texts and len({uuid.UUID(r.i) for r in rows}) == len(texts)


def test_startup_totals(spark):
    t = spark.createDataFrame([("u", 1), ("u", 2), ("w", 3)], "user_id string, n long")
    got = {(r.user_id, r.entity): (r["items"], r.bytes, r.pending) for r in metrics.startup({"a": t, "b": t.limit(0)}, {"b": t.where("n > 1")}, lambda df: F.col("n")).collect()}
    assert got == {(None, None): (3, 6, 2), ("u", None): (2, 3, 1), ("w", None): (1, 3, 1), ("u", "a"): (2, 3, 0), ("w", "a"): (1, 3, 0), ("u", "b"): (0, 0, 1), ("w", "b"): (0, 0, 1)}
