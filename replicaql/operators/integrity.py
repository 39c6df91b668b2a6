"""Content hashes, entity counts, sync metadata and the need for a full sync."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh
from . import hashtree


def content_hash(df: DataFrame, columns: Sequence[str], key: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, hash: SHA-256 of the rows as a JSON list in key order. A group is one text: choose by so that groups fit."""
    rows = df.select(*by, F.struct(F.col(key).alias("k"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(text, 256).alias("hash"))


def rolling_hash(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """An order-free fingerprint for tables of any size: the sum of row hashes, combined map-side."""
    row = F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(row).alias("fingerprint"))


def metadata(tables: dict[str, DataFrame], now: Column, user: str = "user_id") -> DataFrame:
    """Per user: last_sync_time and entity_counts (map of entity to rows)."""
    parts = None
    for name, df in tables.items():
        one = df.groupBy(F.col(user).alias("user_id")).agg(F.count("*").alias("n")).withColumn("entity", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "n"))))
    return parts.groupBy("user_id").agg(counts.alias("entity_counts")).withColumn("last_sync_time", now)


def hashed_metadata(tables: dict[str, tuple[DataFrame, Sequence[str], str]], now: Column, depth: int = 2) -> DataFrame:
    """Per user_id: entity_counts (map of entity to n and hash, the root of its hash tree), data_hash (of all entities) and
    last_sync_time. tables: entity to rows with a user_id, hashed columns, and key."""
    parts = [hashtree.roots(df, columns, key, ["user_id"], depth).withColumn("entity", F.lit(name)) for name, (df, columns, key) in tables.items()]
    entities = F.array_sort(F.collect_list(F.struct("entity", "n", "hash")))  # one for each entity at most
    found = reduce(DataFrame.unionByName, parts).groupBy("user_id").agg(entities.alias("e"))
    counts = F.map_from_entries(F.transform("e", lambda x: F.struct(x["entity"], F.struct(x["n"], x["hash"]))))
    whole = F.sha2(F.array_join(F.transform("e", lambda x: F.concat(x["entity"], F.lit(":"), x["hash"])), ","), 256)
    return found.select("user_id", counts.alias("entity_counts"), whole.alias("data_hash"), now.alias("last_sync_time"))


def save_metadata(meta: DataFrame, *replicas: str) -> None:
    """Appends the metadata to the folder of each replica; it is computed once."""
    spark, path = meta.sparkSession, fresh(meta.sparkSession, "metadata")
    meta.write.parquet(path)
    for replica in replicas:
        spark.read.schema(meta.schema).parquet(path).write.mode("append").parquet(replica)


def saved_metadata(spark: SparkSession, replica: str) -> DataFrame:
    """The last metadata of each user."""
    rows = spark.read.parquet(replica)
    rest = [c for c in rows.columns if c != "user_id"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*rest), "last_sync_time").alias("x")).select("user_id", "x.*")


def needs_full_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """user_id and full: whether the metadata rows (user_id, data_hash, last_sync_time) call for a full sync."""
    r = remote.select("user_id", F.col("data_hash").alias("rh"), F.col("last_sync_time").alias("rt"))
    both = local.select("user_id", F.col("data_hash").alias("lh"), F.col("last_sync_time").alias("lt")).join(r, "user_id", "full_outer")
    return both.select("user_id", (F.col("lt").isNull() | F.col("rt").isNull() | ~F.col("lh").eqNullSafe(F.col("rh"))).alias("full"))
