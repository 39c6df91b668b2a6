"""Status and health as streams: the last report of every manager, joined over all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics

#: A report: whether the remote side is reachable, and whether each side is well.
REPORT = "manager string, reachable boolean, local_ok boolean, remote_ok boolean, ts timestamp"


def latest(*reports: DataFrame) -> DataFrame:
    """Each manager's last report over all streams (of equal times the worse one); a row a manager is the state. For complete or update mode."""
    rows = reduce(DataFrame.unionByName, [r.select("manager", "reachable", "local_ok", "remote_ok", "ts") for r in reports])
    bad = (~F.col("reachable")).cast("int") * 4 + (~F.col("local_ok")).cast("int") * 2 + (~F.col("remote_ok")).cast("int")
    return rows.groupBy("manager").agg(F.max_by(F.struct("reachable", "local_ok", "remote_ok", "ts"), F.struct("ts", bad)).alias("x")).select("manager", "x.*")


def healths(last: DataFrame) -> DataFrame:
    """manager and health: offline before degraded before healthy."""
    return last.select("manager", metrics.state(F.col("reachable"), F.col("local_ok") & F.col("remote_ok")).alias("health"))


def watch_health(reports: Sequence[DataFrame], emit: Callable[[DataFrame, str, int], None], checkpoint: str, **trigger):
    """After each batch emit gets every manager's health, the health of all together, and the batch's number."""

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()  # a state's rows: one for each manager
        whole = metrics.health(held).first()
        emit(healths(held), whole["health"], number)
        held.unpersist()

    return latest(*reports).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
