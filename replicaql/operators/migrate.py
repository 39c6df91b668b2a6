"""Schema migrations: a chain of DataFrame steps from one version to another."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import MigrationError
from ..sources.store import SnapshotStore


@dataclass(frozen=True)
class Migration:
    from_version: int
    to_version: int
    step: Callable[[DataFrame], DataFrame]


def chain(migrations: Sequence[Migration], start: int, target: int) -> list[Migration]:
    """The steps from start to target; a missing or backward step is an error."""
    by_start = {m.from_version: m for m in migrations}
    found, at = [], start
    while at < target:
        m = by_start.get(at)
        if m is None or m.to_version <= at:
            raise MigrationError(f"no migration from version {at} towards {target}")
        found.append(m)
        at = m.to_version
    return found


def migrate(df: DataFrame, migrations: Sequence[Migration], start: int, target: int) -> DataFrame:
    for m in chain(migrations, start, target):
        df = df.transform(m.step)
    return df


def migrate_store(store: SnapshotStore, migrations: Sequence[Migration], start: int, target: int, on_error: Callable[[Exception], None] | None = None) -> int:
    """Migrates the current snapshot; returns the schema version in force. An error keeps the old snapshot and goes to
    on_error, or is raised."""
    try:
        if start < target:
            store.transaction(lambda df: migrate(df, migrations, start, target))
        return max(start, target)
    except Exception as error:
        if on_error is None:
            raise
        on_error(error)
        return start
