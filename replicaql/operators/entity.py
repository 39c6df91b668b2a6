"""Entity tables: the envelope, target projections, middleware and adapters' row scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import EntityNotFound, ReplicaError
from ..plans.compiler import apply
from ..plans.model import Query

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Entity:
    """A table's name, payload, columns of only one replica, relations and row transforms."""

    name: str
    payload: tuple[str, ...] = ()
    local_only: tuple[str, ...] = ()
    remote_only: tuple[str, ...] = ()
    relations: dict = field(default_factory=dict)
    before_save: tuple[Step, ...] = ()
    after_fetch: tuple[Step, ...] = ()

    def relation(self, name: str):
        if not self.relations:
            raise ReplicaError(f"{self.name} has no relations")
        if name not in self.relations:
            raise ReplicaError(f"{self.name} has no relation {name}")
        return self.relations[name]


def project(df: DataFrame, entity: Entity, target: str) -> DataFrame:
    """The columns that a replica (local or remote) holds."""
    if target not in ("local", "remote"):
        raise ValueError("targets are local and remote")
    hidden = entity.remote_only if target == "local" else entity.local_only
    return df.drop(*hidden)


def pipe(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def saved(df: DataFrame, entity: Entity) -> DataFrame:
    """Rows as they are saved: the transforms before saving, in order."""
    return pipe(df, entity.before_save)


def fetched(df: DataFrame, entity: Entity) -> DataFrame:
    """Rows as they are returned: the transforms after fetching, in order."""
    return pipe(df, entity.after_fetch)


def scan(df: DataFrame, user_id: object = None, column: str = "user_id", entity: Entity | None = None) -> DataFrame:
    """All rows, deleted ones included, or one user's; after an entity's transforms, if one is given."""
    rows = df if user_id is None else df.where(F.col(column) == F.lit(user_id))
    return rows if entity is None else fetched(rows, entity)


def scoped(df: DataFrame, scope: Query | None = None, user_id: object = None, column: str = "user_id") -> DataFrame:
    """A remote read of the rows that a scope's filters keep; its order and limits don't count."""
    df = scan(df, user_id, column)
    return df if scope is None else apply(df, Query(filters=scope.filters, logic=scope.logic))


def counts(df: DataFrame, column: str = "user_id", name: str = "n") -> DataFrame:
    """Rows of each user: pending operations of a queue, or entities of a table."""
    return df.groupBy(F.col(column).alias("user_id")).agg(F.count("*").alias(name))


def lookup(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == F.lit(key)).limit(1)


def lookup_many(df: DataFrame, ids: DataFrame | Sequence, column: str = "id") -> DataFrame:
    """Rows with the given ids; ids: a DataFrame with that column, or a short list."""
    return df.join(ids.select(column).distinct(), column, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(column).isin(list(ids)))


def read(df: DataFrame, key: object, column: str = "id") -> Row:
    """The row of a key; none is an error."""
    row = lookup(df, key, column).first()
    if row is None:
        raise EntityNotFound(f"no row with {column} {key}")
    return row


def required(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows with the given ids; an id without a row fails the job, which names it."""
    wanted = ids.select(F.col(column).alias("wanted_")).distinct()
    found = df.withColumn("there_", F.lit(True)).join(wanted, F.col(column) == F.col("wanted_"), "right")
    lost = F.raise_error(F.concat(F.lit(f"no row with {column} "), F.coalesce(F.col("wanted_").cast("string"), F.lit("null")))).cast("boolean")
    return found.where(F.when(F.col("there_").isNull(), lost).otherwise(F.lit(True))).select(*df.columns)


def users(df: DataFrame, column: str = "user_id") -> DataFrame:
    return df.select(column).distinct()


def storage_size(df: DataFrame) -> DataFrame:
    """Characters of the rows as a JSON list: rows, commas and brackets."""
    rows = df.select(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("n"))
    return rows.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) + 2).alias("size"))
