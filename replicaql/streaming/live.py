"""Change streams: the source, exact duplicate suppression, live queries, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import entity, relations

CHANGE = T.StructType([T.StructField("type", T.StringType()), T.StructField("entity_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("data", T.StringType()), T.StructField("source_id", T.StringType())])


def change_source(spark: SparkSession, path: str, schema: T.StructType = CHANGE, files: int = 100) -> DataFrame:
    """The change log as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def of_type(events: DataFrame, *types: str, column: str = "event_type") -> DataFrame:
    return events.where(F.col(column).isin(list(types)))


def suppress(events: DataFrame, key: str, ts: str, order: Sequence[str], ttl_s: float = 5.0) -> DataFrame:
    """Batch twin of suppress_stream: an event is accepted iff it is more than the TTL after its key's last accepted one.

    One ordered pass over each key's events that carries the last accepted time; a chain of duplicates does not extend
    the wait. A gap above the TTL starts a new run, and runs are dealt out separately.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(ts, *order)
    rows = events.withColumn("t_", micros).withColumn("gap_", F.col("t_") - F.lag("t_").over(w))
    # a gap above the TTL always ends a run: its first event is accepted whatever came before
    rows = rows.withColumn("run_", F.count_if(F.col("gap_").isNull() | (F.col("gap_") > ttl_s * 1e6)).over(w))
    # rows before their run's first accepted successor are told by jumps: each run is read once, in order
    runs = rows.select(key, "run_", "t_", *order).repartition(key, "run_").sortWithinPartitions(key, "run_", "t_", *order)
    names, kinds = [key, *order], T.StructType([events.schema[c] for c in (key, *order)])

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, 0
        for b in batches:
            keys, t, keep = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(2).to_pylist(), []
            for k, at in zip(keys, t, strict=True):
                fine = k != run or at - last > ttl_s * 1e6
                if fine:
                    run, last = k, at
                keep.append(fine)
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return runs.mapInArrow(accept, kinds)


class _Accepting(StatefulProcessor):
    """Of each key the time of its last accepted event (t_, microseconds), until no event can fall within its TTL any more."""

    def __init__(self, order: Sequence[str], ttl: int):
        self.order, self.ttl = ("t_", *order), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            if last is None or row["t_"] - last > self.ttl:
                last = row["t_"]
                yield row
        if last != before:
            self.last.update((last,))
            # timers and watermarks are in milliseconds: one more, so that none comes early
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[0] + self.ttl < timerValues.getCurrentWatermarkInMs() * 1000:
            self.last.clear()
        return iter(())


def suppress_stream(events: DataFrame, key: str, ts: str, ttl_s: float = 5.0, order: Sequence[str] = (), lateness: str = "0 seconds") -> DataFrame:
    """Exact duplicate suppression: within a batch events go by ts and order; batches come in time order, but for lateness.

    A key's state is one time, and it ends: a timer clears it once the watermark has passed the TTL, from where on every event that still
    counts would be accepted anyway. Events without a time are dropped. Needs the RocksDB provider (deltas.rocksdb).
    """
    timed = events.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).withColumn("t_", F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.groupBy(key).transformWithState(_Accepting(order, round(ttl_s * 1e6)), timed.schema, "Append", "EventTime").drop("t_")


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key; deletes drop out in apply()."""
    fields = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("x")).select(key, "x.*")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: Sequence[str], kind: str = "type") -> DataFrame:
    """base after the changes (columns of base, and kind: create, update, delete)."""
    last = latest(changes, key, order)
    return base.join(last.select(key), key, "left_anti").unionByName(last.where(F.col(kind) != "delete").select(*base.columns))


def watch(changes: DataFrame, snapshot: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], query: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, initial: bool = True, **trigger):
    """A live query: each micro-batch of changes is applied, then the query over the new snapshot is emitted.

    Emissions are one a batch: the last state of a batch equals the batch query. Empty batches emit nothing.
    """
    if initial:
        emit(query(snapshot()), -1)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            apply(df, number)
            emit(query(snapshot()), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_count(changes: DataFrame, *by: str) -> DataFrame:
    """A running count (complete mode)."""
    return changes.groupBy(*by).agg(F.count("*").alias("n"))


def applied(changes: DataFrame, user_id: object = None) -> DataFrame:
    """External changes that a replica takes over: all of them, or those of one user."""
    return changes if user_id is None else changes.where(F.col("user_id") == F.lit(user_id))


def queued(changes: DataFrame, source: str = "source_id", kind: str = "type", local: str = "local") -> DataFrame:
    """External changes that become pending operations: those of the local side, but never its deletes."""
    return changes.where((F.col(source) == local) & (F.col(kind) != "delete"))


def by_id(key: object, column: str = "id") -> Callable[[DataFrame], DataFrame]:
    """For watch(): one row."""
    return lambda df: df.where(F.col(column) == F.lit(key)).limit(1)


def by_page(key: Sequence[str], page: int = 1, size: int = 50) -> Callable[[DataFrame], DataFrame]:
    """For watch(): one page."""
    return lambda df: df.orderBy(*key).offset((page - 1) * size).limit(size)


def by_relation(parents: Callable[[], DataFrame], relation, pivot: Callable[[], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """For watch() over the related table: the rows that belong to the parents as they are then."""
    return lambda df: relations.fetch(parents(), relation, df, pivot() if pivot else None)


def by_size() -> Callable[[DataFrame], DataFrame]:
    """For watch(): the table's storage size."""
    return entity.storage_size
