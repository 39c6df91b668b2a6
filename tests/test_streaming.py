import datetime as dt
import random

from pyspark.sql import functions as F

from replicaql.streaming import deltas, live


def _events(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, rng.randrange(5), start + dt.timedelta(seconds=rng.randrange(4000) / 10)) for i in range(400)], "event_id long, user_id long, ts timestamp")


def _accepted(rows, ttl):
    last, out = {}, set()
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() > ttl:
            last[r.user_id] = r.ts
            out.add(r.event_id)
    return out


def test_suppress(spark, tmp_path):
    events = _events(spark)
    want = _accepted(events.collect(), 5.0)
    assert {r.event_id for r in live.suppress(events, "user_id", "ts", ["event_id"]).collect()} == want
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set(deltas.PROVIDER, deltas.ROCKSDB)
    stream = live.suppress_stream(live.change_source(spark, f"{tmp_path}/in", events.schema), "user_id", "ts")
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len({r.event_id for r in spark.table("kept").collect()}) == len(want)


def test_watch(spark, tmp_path):
    log = spark.createDataFrame([("create", 1, 5), ("update", 1, 6), ("delete", 2, 7), ("create", 3, 1)], "type string, id int, v int")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    held = [spark.createDataFrame([(2, 0)], "id int, v int")]
    seen = []

    def apply(df, number):
        rows = live.apply_changes(held[0], df, "id", ["v"]).collect()
        held[0] = spark.createDataFrame(rows, "id int, v int")

    q = live.watch(live.change_source(spark, f"{tmp_path}/log", log.schema), lambda: held[0], apply, lambda df: df.orderBy(F.desc("v")), lambda df, n: seen.append([r.id for r in df.collect()]), f"{tmp_path}/cp")
    q.awaitTermination()
    assert seen == [[2], [1, 3]]
