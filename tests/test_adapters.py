"""The data source, raw scans over schema versions, streams of versions and of health."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from replicaql.errors import SourceError
from replicaql.operators import entity, rawscan
from replicaql.plans.catalogue import _QUERIES
from replicaql.plans.compiler import apply
from replicaql.plans.model import Filter, Op, QueryBuilder
from replicaql.sources import adapter
from replicaql.streaming import status

DIR = "/root/testdata/sf0.001"


def _read(spark, path, **options):
    adapter.register(spark)
    return spark.read.format(adapter.FORMAT).options(path=path, **options).load()


def test_flagship_by_the_data_source(spark, capfd):
    query = QueryBuilder().where("o_orderstatus", eq="O").any_of([Filter("o_orderpriority", Op.IN, ("1-URGENT", "2-HIGH")), Filter("o_totalprice", Op.GT, 200000.0)]).order_by("o_totalprice", True).limit(10).offset(20).build()
    with adapter.pushdown(spark):
        df = apply(_read(spark, f"{DIR}/orders.parquet"), query, ("o_orderkey",)).select("o_orderkey", "o_totalprice", "o_orderpriority")
        rows = df.collect()
        df.explain("formatted")
    plan = capfd.readouterr().out
    assert "o_orderstatus" in plan.split("PushedFilters")[1].split("\n")[0]
    assert rows == _QUERIES["q_flagship"](spark, DIR).collect()


@pytest.mark.parametrize("text", ["o_orderstatus <> 'O'", "o_totalprice >= 100000 and o_totalprice < 150000", "o_orderpriority like '1%'", "o_orderpriority like '%H'", "o_orderpriority like '%RG%'", "o_orderkey in (1, 5, 7)", "o_orderkey is null", "o_orderkey <= 9", "length(o_orderpriority) = 5", "o_orderdate > timestamp'2024-01-01'"])
def test_filters_pushed_or_not(spark, text):
    with adapter.pushdown(spark):
        got = sorted(r.o_orderkey for r in _read(spark, f"{DIR}/orders.parquet").where(text).collect())
    assert got == sorted(r.o_orderkey for r in spark.read.parquet(f"{DIR}/orders.parquet").where(text).collect())


def test_targets_and_change_log(spark, tmp_path):
    pq.write_table(pa.table({"id": [1, 2], "secret": ["a", None], "v": [1.5, None]}), f"{tmp_path}/t.parquet")
    for n, ids in ((1, [1, 2]), (2, [3])):
        (tmp_path / "log").mkdir(exist_ok=True)
        pq.write_table(pa.table({"id": ids, "type": ["update"] * len(ids)}), f"{tmp_path}/log/{n:08d}.parquet")
    path = f"{tmp_path}/t.parquet"
    assert _read(spark, path, hidden_remote="secret", target="remote", pushdown="false").columns == ["id", "v"]
    assert sorted(map(tuple, _read(spark, path, hidden_remote="secret", pushdown="false").collect())) == [(1, "a", 1.5), (2, None, None)]

    def drain():
        seen = []
        stream = spark.readStream.format(adapter.FORMAT).options(path=path, changes=f"{tmp_path}/log", target="changes").load()
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.id for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(seen)

    assert drain() == [1, 2, 3]
    pq.write_table(pa.table({"id": [9], "type": ["delete"]}), f"{tmp_path}/log/{3:08d}.parquet")
    assert drain() == [9]
    with pytest.raises(SourceError, match="no change log"):
        adapter.Adapter({}).latest()


def test_raw_scan(spark):
    one = spark.createDataFrame([("u", 1, "12", "x"), ("u", 2, "many", None), ("w", 3, None, "y")], "user_id string, id long, n string, old string")
    two = spark.createDataFrame([("u", 4, 7, True)], "user_id string, id long, n int, fresh boolean")
    rows = {r.id: r for r in rawscan.raw_scan({1: one, 2: two}).collect()}
    assert (rows[1].n, rows[1].rest, rows[1].schema_version) == (12, {"old": "x"}, 1) and (rows[2].n, rows[2].rest) == (None, {"n": "many"})
    assert rows[3].rest == {"old": "y"} and (rows[4].n, rows[4].fresh, rows[4].rest, rows[4].schema_version) == (7, True, None, 2)
    assert {r.id for r in rawscan.raw_scan({1: one, 2: two}, "u").collect()} == {1, 2, 4} and rawscan.raw_scan({2: two}).columns == ["schema_version", *two.columns, "rest"]
    e = entity.Entity("t", after_fetch=(lambda d: d.withColumn("n", F.col("n") + 1),))
    assert [r.n for r in entity.scan(two, "u", entity=e).collect()] == [8]


def test_versions_start_migrations(spark, tmp_path):
    kinds = "table string, version int, at long"
    for n, rows in enumerate([[("a", 1, 1), ("b", 3, 1), ("a", 2, 2)], [("a", 3, 3), ("c", 0, 3)]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    begun = []
    rawscan.watch_versions(stream, 3, lambda t, v: begun.append((t, v)), f"{tmp_path}/cp").awaitTermination()
    assert begun == [("a", 2), ("c", 0)]


def test_health_of_all_managers(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    batches = [
        [("m1", True, True, True, at(1))], [("m2", True, True, False, at(2)), ("m2", True, True, True, at(1))], [("m1", False, True, True, at(3))],
        [("m1", True, True, True, at(4)), ("m2", True, True, True, at(4)), ("m1", False, True, True, at(0))], [("m2", True, False, True, at(5)), ("m2", True, True, True, at(5))],
    ]
    streams = []
    for side in (0, 1):  # the managers report by turns in two streams
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows if n % 2 == side else [], status.REPORT).coalesce(1).write.parquet(f"{tmp_path}/in{side}/{n}")
        streams.append(spark.readStream.schema(status.REPORT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in{side}"))
    seen = {}
    status.watch_health(streams, lambda each, whole, n: seen.setdefault(n, ({r.manager: r.health for r in each.collect()}, whole)), f"{tmp_path}/cp").awaitTermination()
    last = list(seen.values())
    assert [w for _, w in last] == ["healthy", "degraded", "offline", "healthy", "degraded"]
    assert last[2][0] == {"m1": "offline", "m2": "degraded"} and last[4][0] == {"m1": "healthy", "m2": "degraded"}
