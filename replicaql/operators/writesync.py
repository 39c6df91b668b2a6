"""Writes that are synchronised at once: the local change, its operations replayed on the remote side, and the pull after."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import changes, reconcile


class Synced(NamedTuple):
    """Both tables after the synchronisation, the operations that went out, and the pull's rows (for pull_metrics() and conflicts)."""

    local: DataFrame
    remote: DataFrame
    log: DataFrame
    found: DataFrame


def synchronise(local: DataFrame, remote: DataFrame, queue: DataFrame, resolver: reconcile.Resolver = reconcile.last_write_wins, merge=None, key: str = "id") -> Synced:
    """Replays the queue on the remote rows of the same user and key, then pulls every user's remote rows.

    queue: user_id, key, seq (unique for each user and key), type, full (struct of the tables' columns) and delta. Users that
    share keys stay apart throughout; rows are moved by user and key, so no user's rows meet in one task.
    """
    place = F.struct("user_id", key)
    columns = remote.columns
    ops = queue.select(place.alias("at_"), "seq", "type", "full", "delta")
    after = changes.replay(remote.withColumn("at_", place), ops, columns, "at_").select(*columns)
    found = reconcile.matched(local, after, resolver=resolver, key=key, each=True)
    return Synced(reconcile.pull(found, merge, key), after, queue, found)


def push_and_sync(local: DataFrame, remote: DataFrame, rows: DataFrame, seq: Column, now: Column, before_save: Sequence = (), **options) -> Synced:
    """Creates or updates rows by (user_id, id) and synchronises; rows that change nothing queue nothing. An update is the same."""
    saved, log = changes.push(local, rows, ["user_id", "id"], local.columns, F.col("user_id"), seq, now, before_save=before_save)
    return synchronise(saved, remote, log, **options)


def delete_and_sync(local: DataFrame, remote: DataFrame, keys: DataFrame, seq: Column, now: Column, **options) -> Synced:
    """Deletes by (user_id, id) and synchronises; a key without a local row queues nothing, so what only the remote side has comes back."""
    both = ["user_id", "id"]
    went = changes.deleted(local, keys, both).where("went").select(*both, F.lit("delete").alias("change"))
    empty = F.lit(None).cast(local.schema)
    log = changes.operation_log(went.withColumn("delta", F.lit(None).cast("map<string,string>")).withColumn("full", empty), F.col("user_id"), seq, now)
    return synchronise(changes.delete(local, keys, both), remote, log, **options)
