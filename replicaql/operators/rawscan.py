"""Rows of several schema versions as one table, without decoding, and migrations that a stream of versions starts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, REST = "schema_version", "rest"


def raw_scan(snapshots: Mapping[int, DataFrame], user_id: object = None, user: str = "user_id") -> DataFrame:
    """schema_version, the columns of the newest version, and rest: a map of what these can't hold, as text by name.

    A column that the newest version lacks goes to rest, and so does a value that its type can't hold (the column is null then); nulls don't. Each
    snapshot is scanned once, with its own filter on the user. A rest that is empty is null.
    """
    newest = snapshots[max(snapshots)]
    kinds = {f.name: f.dataType for f in newest.schema.fields}
    parts = []
    for version, df in sorted(snapshots.items()):
        if user_id is not None:
            df = df.where(F.col(user) == F.lit(user_id))
        held, lost = [], []
        for c, kind in kinds.items():
            if c not in df.columns:
                held.append(F.lit(None).cast(kind).alias(c))
            elif df.schema[c].dataType == kind:
                held.append(F.col(c))
            else:
                held.append(F.col(c).try_cast(kind).alias(c))
                lost.append(F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), F.struct(F.lit(c), F.col(c).cast("string"))))
        lost += [F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in df.columns if c not in kinds]
        rest = F.map_from_entries(F.filter(F.array(*lost), lambda x: x.isNotNull())) if lost else F.lit(None).cast("map<string,string>")
        parts.append(df.select(F.lit(version).alias(VERSION), *held, F.when(F.size(rest) > 0, rest).cast("map<string,string>").alias(REST)))
    return reduce(DataFrame.unionByName, parts)


def watch_versions(versions: DataFrame, target: int, migrate: Callable[[str, int], None], checkpoint: str, **trigger):
    """Starts a migration for each table whose last version in the stream (table, version, at) is below target, once for each such version.

    versions: one row for each version that a table takes, so a batch's tables, not its rows, reach the driver."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("table").agg(F.max_by("version", "at").alias("version")).where(F.col("version") < target)
        for r in last.orderBy("table").toLocalIterator():
            migrate(r["table"], r["version"])

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
