"""Live queries maintained by signed changes.

signed() turns a stream of changes into retractions (-1: the row as it was) and additions (+1: the row as it is); the rows lie
in the stream's state by key, so nothing scans a snapshot. Counts and top-k lists are then small tables, of which each
batch makes the next version: a count adds the signs of its group, a top-k drops what was retracted and takes what was added, and
is computed anew only where a row of it went and others may follow that it doesn't know.

Streams with state need spark.sql.streaming.stateStore.providerClass to be the RocksDB provider (ROCKSDB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.compiler import apply
from ..plans.model import Query
from .sink import Version, batches, once

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGN = "sign"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB provider for streams that start within; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class _Rows(StatefulProcessor):
    """Of each key the row as it is."""

    def __init__(self, columns: Sequence[str], schema: T.StructType, order: str, kind: str):
        self.columns, self.schema, self.order, self.kind, self.row = columns, schema, order, kind, Row(*columns, SIGN)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("row", self.schema)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.held.update(tuple(initialState[c] for c in self.columns))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.held.get() if self.held.exists() else None
        old = None if old is None else tuple(old)
        last = max(rows, key=lambda r: r[self.order], default=None)
        if last is None:  # the key's initial row alone
            return
        new = None if last[self.kind] == "delete" else tuple(last[c] for c in self.columns)
        if new == old:
            return
        if old is not None:
            yield self.row(*old, -1)
        if new is not None:
            self.held.update(new)
            yield self.row(*new, 1)
        else:
            self.held.clear()


def signed(changes: DataFrame, key: str, columns: Sequence[str], order: str, kind: str = "type", base: DataFrame | None = None) -> DataFrame:
    """columns (key among them) and sign. changes: whole rows, order (no two equal for a key), and kind (create, update, delete).

    A batch gives a key one retraction and one addition at most, and none if it leaves the row as it was. base: the rows before the
    stream's first batch, which make no signs.
    """
    schema = T.StructType([changes.schema[c] for c in columns])
    start = None if base is None else base.select(*columns).groupBy(key)
    out = T.StructType([*schema.fields, T.StructField(SIGN, T.IntegerType())])
    return changes.groupBy(key).transformWithState(_Rows(columns, schema, order, kind), out, "Append", "None", start)


def live_counts(changes: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), where: Column | None = None, start: DataFrame | None = None, emit: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Counts (n) of the rows that where keeps, by group, after each batch. changes: of signed(); start: the groups' counts (by, n) before
    the first batch. Work is by changed rows and groups."""
    spark = changes.sparkSession
    schema = T.StructType([*[T.StructField(c, changes.schema[c].dataType) for c in by], T.StructField("n", T.LongType())])
    counts = Version(spark, f"{path}/counts", schema)
    counts.write(spark.createDataFrame([], schema) if start is None else start, -1)

    def batch(df: DataFrame, number: int) -> None:
        rows = df if where is None else df.where(where)
        more = rows.groupBy(*by).agg(F.sum(SIGN).cast("long").alias("n")) if by else rows.agg(F.coalesce(F.sum(SIGN), F.lit(0)).cast("long").alias("n"))
        counts.write(counts.read(number).union(more).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).where(F.lit(not by) | (F.col("n") != 0)), number)
        if emit:
            emit(counts.read(), number)

    return _started(changes, batch, checkpoint, trigger)


def live_top(changes: DataFrame, query: Query, key: Sequence[str], path: str, checkpoint: str, rows_after: Callable[[int], DataFrame], start: DataFrame, emit: Callable[[DataFrame, int, bool], None] | None = None, **trigger):
    """The rows of a query with an order and a limit after each batch. changes: of signed(); start: the rows before the first batch;
    rows_after(number): all rows after a batch, asked for only where the list can't be told from changes. emit gets the rows, the
    batch, and whether they were computed anew."""
    if not query.limit:
        raise ValueError("a live top-k needs a limit; watch() evaluates any query")
    spark, size = changes.sparkSession, query.limit + (query.offset or 0)
    schema = T.StructType([f for f in changes.schema.fields if f.name != SIGN])
    whole = Query(filters=query.filters, logic=query.logic, sorting=query.sorting, limit=size)
    last = Query(sorting=query.sorting, limit=size)
    top = Version(spark, f"{path}/top", schema)
    top.write(apply(start.select(*schema.names), whole, tuple(key)), -1)

    def batch(df: DataFrame, number: int) -> None:
        once(df, f"{path}/signed", number)  # the one job over the stream's state
        found = batches(spark, f"{path}/signed", changes.schema).where(F.col("batch") == number)
        gone = found.where(F.col(SIGN) < 0).select(*key)
        more = apply(found.where(F.col(SIGN) > 0).select(*schema.names), Query(filters=query.filters, logic=query.logic))
        old = top.read(number)
        there = old.count()
        left = old.join(gone, list(key), "left_anti").select(*schema.names)
        known = apply(left.unionByName(more), last, tuple(key))
        anew = False
        if there == size and left.count() < there:
            # rows behind the old last one aren't known: the list holds if all its rows stand before that
            edge = apply(old.withColumn("edge_", F.lit(1)), Query(sorting=query.sorting, limit=1, offset=size - 1), tuple(key))
            with_edge = apply(known.withColumn("edge_", F.lit(0)).unionByName(edge), last, (*key, "edge_"))
            anew = with_edge.where("edge_ = 0").count() < size
        top.write(apply(rows_after(number).select(*schema.names), whole, tuple(key)) if anew else known, number)
        if emit:
            emit(apply(top.read(), Query(sorting=query.sorting, limit=query.limit, offset=query.offset), tuple(key)), number, anew)

    return _started(changes, batch, checkpoint, trigger)


def _started(changes: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict):
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
