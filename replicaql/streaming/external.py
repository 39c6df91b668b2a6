"""Changes from outside, applied once: what each batch brings is kept by its number, and tables are their base with the changes on top.

A batch writes its changes and then the operations that they queue, each as the partition of its number. If it is repeated after a
failure, it replaces both, and it compares with the rows before it, so nothing is doubled or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relations
from ..operators.relations import BelongsTo, HasMany, HasOne
from .live import apply_changes
from .sink import BATCH, batches, once


class ExternalChanges:
    """A table that takes over the changes of a stream (columns, kind, order and source).

    Changes of the remote side are applied; those of the local side are applied and queued for the remote one, but for deletes and for
    rows that are as they were.
    """

    def __init__(self, path: str, base: DataFrame, key: str, columns: Sequence[str], order: str = "ts", kind: str = "type", source: str = "source_id"):
        self.path, self.base, self.key, self.columns, self.order, self.kind, self.source = path, base, key, list(columns), order, kind, source
        self.schema: T.StructType | None = None

    def changes(self, before: int | None = None) -> DataFrame:
        rows = batches(self.base.sparkSession, f"{self.path}/changes", self.schema)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def rows(self, before: int | None = None) -> DataFrame:
        """The table as it is, or as it was before a batch."""
        return apply_changes(self.base.select(*self.columns), self.changes(before), self.key, [BATCH, self.order], self.kind)

    def queue(self) -> DataFrame:
        """Pending operations (key, type, delta, full, order), with their batch."""
        return self.base.sparkSession.read.parquet(f"{self.path}/queue")

    def _operations(self, number: int) -> DataFrame:
        """Each local change against the row that it meets: the batch's change before it, or the row before the batch."""
        new = self.changes().where(F.col(BATCH) == number)
        held = self.rows(number).join(new.select(self.key).distinct(), self.key, "left_semi")
        full = F.struct(*self.columns)
        steps = new.select(self.key, F.lit(1).alias("new_"), F.col(self.order).alias("at_"), F.col(self.kind).alias("kind_"), F.col(self.source).alias("source_"), full.alias("full"))
        start = held.select(self.key, F.lit(0).alias("new_"), F.lit(None).cast(self.schema[self.order].dataType).alias("at_"), F.lit("update").alias("kind_"), F.lit("base").alias("source_"), full.alias("full"))
        w = W.partitionBy(self.key).orderBy("new_", "at_")
        there = F.lag(F.when(F.col("kind_") != "delete", F.col("full"))).over(w)
        steps = steps.unionByName(start).withColumn("there_", there).where((F.col("new_") == 1) & (F.col("source_") == "local") & (F.col("kind_") != "delete"))
        parts = [F.when(~F.col(f"there_.{c}").eqNullSafe(F.col(f"full.{c}")), F.struct(F.lit(c), F.col(f"full.{c}").cast("string"))) for c in self.columns if c != self.key]
        delta = F.map_from_entries(F.filter(F.array(*parts), lambda x: x.isNotNull()))
        create = F.col("there_").isNull()
        ops = steps.select(self.key, F.when(create, "create").otherwise("update").alias("type"), F.when(~create, delta).alias("delta"), "full", F.col("at_").alias(self.order))
        return ops.where((F.col("type") == "create") | (F.size("delta") > 0))

    def batch(self, df: DataFrame, number: int) -> None:
        """For foreachBatch: one job over the stream's rows, then all else from what it wrote."""
        once(df, f"{self.path}/changes", number)
        once(self._operations(number), f"{self.path}/queue", number)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        self.schema = stream.schema
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Side:
    """A table of a live relation: its rows before the stream, and its changes (columns, order, and kind)."""

    base: DataFrame
    changes: DataFrame
    key: str
    columns: tuple[str, ...]
    order: str = "ts"
    kind: str = "type"


def _in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is among the one column of keys."""
    named = keys.select(F.col(keys.columns[0]).alias("in_")).where("in_ is not null").distinct()
    return df.join(named, df[column] == named["in_"], "left_semi")


class LiveRelation:
    """Related rows of the parents, as parents, related rows and the pivot change.

    The changes of all tables go through one stream, so that a batch sees them together. A batch finds the parents that it can
    have touched by semi-joins with the rows it changed, as they were and as they are, and only these are evaluated again.
    """

    def __init__(self, path: str, relation, sides: dict[str, Side], parent_id: str = "id"):
        self.path, self.relation, self.sides, self.parent_id = path, relation, sides, parent_id
        self.spark: SparkSession = sides["parents"].base.sparkSession

    _LOG = T.StructType([T.StructField("side", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.StringType()), T.StructField("row", T.StringType())])
    _STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # so that times keep their microseconds as text

    def stream(self) -> DataFrame:
        """All changes as one stream: rows travel as JSON, orders as text of equal length."""
        parts = []
        for name, s in self.sides.items():
            at = F.lpad((F.unix_micros(F.col(s.order).cast("timestamp")) if s.changes.schema[s.order].dataType.typeName().startswith("timestamp") else F.col(s.order).cast("long")).cast("string"), 20, "0")
            row = F.to_json(F.struct(*s.columns), {"ignoreNullFields": "false", "timestampFormat": self._STAMP})
            parts.append(s.changes.select(F.lit(name).alias("side"), F.col(s.kind).alias("kind"), at.alias("at"), row.alias("row")))
        return reduce(DataFrame.unionByName, parts)

    def _log(self, name: str) -> DataFrame:
        s = self.sides[name]
        schema = T.StructType([s.base.schema[c] for c in s.columns])
        rows = batches(self.spark, f"{self.path}/log", self._LOG).where(F.col("side") == name)
        return rows.select(F.from_json("row", schema, {"timestampFormat": self._STAMP}).alias("x"), F.col("kind").alias("kind_"), F.col("at").alias("at_"), F.col(BATCH).alias("batch_")).select("x.*", "kind_", "at_", "batch_")

    def rows(self, name: str, number: int) -> DataFrame:
        """A table after a batch."""
        s = self.sides[name]
        return apply_changes(s.base.select(*s.columns), self._log(name).where(F.col("batch_") <= number), s.key, ["batch_", "at_"], "kind_")

    def _touched(self, name: str, number: int) -> DataFrame:
        """The rows that a batch changed, as they were and as they are."""
        s = self.sides[name]
        keys = self._log(name).where(F.col("batch_") == number).select(s.key)
        return _in(self.rows(name, number - 1), s.key, keys).unionByName(_in(self.rows(name, number), s.key, keys))

    def affected(self, number: int) -> DataFrame:
        """The parents, as they are, whose related rows a batch may have changed."""
        rel, parents, related = self.relation, self.rows("parents", number), self._touched("related", number)
        found = _in(parents, self.sides["parents"].key, self._log("parents").where(F.col("batch_") == number).select(self.sides["parents"].key))
        if isinstance(rel, BelongsTo):
            found = found.unionByName(_in(parents, rel.foreign_key, related.select(rel.local_key)))
        elif isinstance(rel, HasMany | HasOne):
            found = found.unionByName(_in(parents, rel.local_key, related.select(rel.foreign_key)))
        else:
            links = self.rows("pivot", number - 1).unionByName(self.rows("pivot", number))
            links = _in(links, rel.other_key, related.select(rel.other_local)).unionByName(self._touched("pivot", number))
            found = found.unionByName(_in(parents, rel.this_local, links.select(rel.this_key)))
        return found.dropDuplicates([self.sides["parents"].key])

    def evaluated(self, parents: DataFrame, number: int) -> DataFrame:
        """parent_key and the related rows of some parents."""
        order = (self.sides["related"].key,) if isinstance(self.relation, HasOne) else ()
        pivot = self.rows("pivot", number) if "pivot" in self.sides else None
        return relations.pairs(parents, self.relation, self.rows("related", number), pivot, order, self.parent_id)

    def start(self, checkpoint: str, emit: Callable[[DataFrame, DataFrame, int], None], initial: bool = True, **trigger):
        """emit gets the affected parents, their related rows (a parent without any has none) and the batch; first all, as batch -1."""
        once(self.spark.createDataFrame([], self._LOG), f"{self.path}/log", -1)
        if initial:
            emit(self.rows("parents", -1), self.evaluated(self.rows("parents", -1), -1), -1)

        def batch(df: DataFrame, number: int) -> None:
            once(df, f"{self.path}/log", number)
            parents = self.affected(number)
            emit(parents, self.evaluated(parents, number), number)

        return self.stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
