"""Folds over sync events and results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_events(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """events: event_type, user_id, failed_count, conflicts_resolved, bytes_pushed, bytes_pulled -> the metrics row."""
    is_ = lambda t: F.col("event_type") == t
    done = is_("completed")
    add = lambda c, when=done: F.coalesce(F.sum(F.when(when, F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    return events.groupBy(*by).agg(
        F.count_if(is_("started")).alias("total_syncs"), F.count_if(done & (F.col("failed_count") == 0)).alias("successful_syncs"),
        (F.count_if(done & (F.col("failed_count") > 0)) + F.count_if(is_("error"))).alias("failed_syncs"),
        add("conflicts_resolved").alias("conflicts_detected"), F.count_if(is_("conflictResolved")).alias("conflicts_resolved"),
        F.count_if(is_("userSwitched")).alias("user_switches"), add("bytes_pushed").alias("bytes_pushed"), add("bytes_pulled").alias("bytes_pulled"),
        F.count_distinct(F.when(is_("started"), F.col("user_id"))).alias("active_users"),
    )


def success_rate(synced: Column, failed: Column) -> Column:
    """Percent of synced among all, 100 where there are none."""
    return F.when(synced + failed == 0, F.lit(100.0)).otherwise(synced * 100.0 / (synced + failed))


def statistics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """results: failed_count, conflicts_resolved, duration_ms -> counts, average and total duration."""
    ok = F.col("failed_count") == 0
    return results.groupBy(*by).agg(F.count("*").alias("total_syncs"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.sum("conflicts_resolved").alias("conflicts"), F.avg("duration_ms").alias("average_ms"), F.sum("duration_ms").alias("total_ms"))


def running_bytes(results: DataFrame, user: str, order: str, size: str) -> DataFrame:
    """Adds total_bytes: a user's bytes up to each result."""
    return results.withColumn("total_bytes", F.sum(size).over(W.partitionBy(user).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def totals(rows: DataFrame, user: str, entity: str, size: str) -> DataFrame:
    """Items and bytes by user and entity, with subtotals and the grand total."""
    return rows.rollup(user, entity).agg(F.count("*").alias("items"), F.sum(size).alias("bytes"))


def startup(tables: dict[str, DataFrame], queues: dict[str, DataFrame], size: Callable[[DataFrame], Column] | None = None, user: str = "user_id") -> DataFrame:
    """user_id, entity, items, bytes and pending of each table and its queue, with subtotals of users and the grand total (nulls), as
    they are before a synchronisation. size: of a row; JSON characters if not given."""
    parts = []
    for name, df in tables.items():
        n = F.length(F.to_json(F.struct("*"))) if size is None else size(df)
        parts.append(df.select(F.col(user).alias("user_id"), F.lit(name).alias("entity"), n.cast("long").alias("bytes"), F.lit(0).alias("waits")))
    for name, df in queues.items():
        parts.append(df.select(F.col(user).alias("user_id"), F.lit(name).alias("entity"), F.lit(None).cast("long").alias("bytes"), F.lit(1).alias("waits")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.rollup("user_id", "entity").agg(F.count_if(F.col("waits") == 0).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sum("waits").alias("pending"))


def combined_switch(parts: DataFrame) -> DataFrame:
    """One result of several user switches: success of all, handled rows, errors joined by '; '."""
    errors = F.array_join(F.array_sort(F.collect_list("error")), "; ")
    return parts.agg(F.bool_and("success").alias("success"), F.sum("handled").alias("handled"), F.when(F.count("error") > 0, errors).alias("errors"))


def state(reachable: Column, well: Column) -> Column:
    """offline before degraded before healthy."""
    return F.when(~reachable, "offline").when(~well, "degraded").otherwise("healthy")


def health(parts: DataFrame) -> DataFrame:
    """parts: reachable, local_ok, remote_ok -> the worst state of all."""
    return parts.agg(state(F.bool_and("reachable"), F.bool_and(F.col("local_ok") & F.col("remote_ok"))).alias("health"))
