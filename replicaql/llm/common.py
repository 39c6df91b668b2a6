"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Words are maximal runs without ASCII white space; bytes.split() without arguments cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: What a broadcast may take at most, measured before it is made.
BROADCAST_BYTES = 32 << 20
#: Text that a classifier is fitted on at most.
SAMPLE_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table of the warehouse (shared like the checkpoint folder), bucketed by key: joins on key don't move it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).saveAsTable(full, format="parquet")
    released(spark)
    return spark.table(full)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs: it does so once the driver's collector has met their owners,
    which a driver with little garbage would otherwise put off while the disks of its executors fill."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on rows of megabytes reach Python workers a few at a time (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, marked for broadcast if its rows, row_bytes each, are proven to take at most BROADCAST_BYTES; else the planner chooses."""
    taken = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


def fitting(sizes: list[int], limit: int) -> list[int]:
    """Which of the sizes, taken in order, are within the limit together; one that would go beyond it is passed over."""
    taken, total = [], 0
    for i, n in enumerate(sizes):
        if total + n <= limit:
            taken.append(i)
            total += n
    return taken


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, seed: int) -> list:
    """Rows (text, label) of a seeded sample: at most max_rows, and of these, in order, all that max_bytes of text have room for."""
    place = (F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).orderBy(*place, label).limit(max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy(*place, "text").limit(max_rows)
    rows = written(rows.withColumn("place", F.row_number().over(W.orderBy(*place, "text"))), "sample")  # max_rows rows at most
    sizes = rows.select("place", F.octet_length("text").alias("n")).orderBy("place").collect()
    whole = fitting([r["n"] for r in sizes], max_bytes)
    if len(whole) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(sizes[i]["place"],) for i in whole], "place int")), "place")
    return rows.orderBy("place").select("text", label).collect()


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the decimal text of an id modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def lower_ascii(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(col, F.lit("")), upper, upper.lower())
