"""Where jobs put what they read again: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local session gets a temporary one; a cluster has no
    folder that a driver could make up for its executors, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="replicaql-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
