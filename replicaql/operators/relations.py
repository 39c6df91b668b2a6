"""Relations between entity tables as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BelongsTo:
    foreign_key: str
    local_key: str = "id"


@dataclass(frozen=True)
class HasMany:
    foreign_key: str
    local_key: str = "id"


@dataclass(frozen=True)
class HasOne:
    foreign_key: str
    local_key: str = "id"


@dataclass(frozen=True)
class ManyToMany:
    this_key: str
    other_key: str
    this_local: str = "id"
    other_local: str = "id"


def _keys(parents: DataFrame, column: str) -> DataFrame:
    return parents.select(F.col(column).alias("parent_key")).where("parent_key is not null").distinct()


def fetch(parents: DataFrame, relation, related: DataFrame, pivot: DataFrame | None = None) -> DataFrame:
    """Related rows of the parents, each once, without the parents' columns (semi-joins)."""
    if isinstance(relation, BelongsTo):
        keys = _keys(parents, relation.foreign_key)
        return related.join(keys, related[relation.local_key] == keys["parent_key"], "left_semi")
    if isinstance(relation, HasMany | HasOne):
        keys = _keys(parents, relation.local_key)
        return related.join(keys, related[relation.foreign_key] == keys["parent_key"], "left_semi")
    keys = _keys(parents, relation.this_local)
    others = pivot.join(keys, pivot[relation.this_key] == keys["parent_key"], "left_semi").select(F.col(relation.other_key).alias("other")).where("other is not null")
    return related.join(others, related[relation.other_local] == others["other"], "left_semi")


def pairs(parents: DataFrame, relation, related: DataFrame, pivot: DataFrame | None = None, order: tuple[str, ...] = (), parent_id: str = "id") -> DataFrame:
    """Each parent's key (for BelongsTo its parent_id) with its related rows. HasOne keeps the first by order."""
    if isinstance(relation, BelongsTo):
        keys = parents.select(F.col(parent_id).alias("parent_key"), F.col(relation.foreign_key).alias("fk_"))
        return keys.join(related, F.col("fk_") == related[relation.local_key]).drop("fk_")
    if isinstance(relation, HasMany):
        keys = _keys(parents, relation.local_key)
        return keys.join(related, F.col("parent_key") == related[relation.foreign_key])
    if isinstance(relation, HasOne):
        keys = _keys(parents, relation.local_key)
        place = F.row_number().over(W.partitionBy(relation.foreign_key).orderBy(*(order or (relation.foreign_key,))))
        # only rows of the parents are ranked
        mine = related.join(keys, related[relation.foreign_key] == keys["parent_key"], "left_semi")
        one = mine.withColumn("place_", place).where("place_ = 1").drop("place_")
        return keys.join(one, F.col("parent_key") == one[relation.foreign_key])
    keys = _keys(parents, relation.this_local)
    # only links of the parents; a pivot may repeat one: once is enough
    links = pivot.select(F.col(relation.this_key).alias("this_"), F.col(relation.other_key).alias("other_")).where("other_ is not null")
    # the keys of a partition are hashed: a sorted link takes many times the bytes that it is moved in
    links = links.join(keys.hint("shuffle_hash"), F.col("this_") == F.col("parent_key"), "left_semi").distinct()
    return links.withColumnRenamed("this_", "parent_key").join(related, F.col("other_") == related[relation.other_local]).drop("other_")
