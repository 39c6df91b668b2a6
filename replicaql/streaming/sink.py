"""Micro-batches written once: what a batch writes is a partition named by its number, so a repeated batch replaces its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def once(df: DataFrame, path: str, number: int) -> None:
    """Writes a batch's rows as its partition. A batch without rows leaves none, which is what a repeat of it would leave too."""
    rows = df.withColumn(BATCH, F.lit(number).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that were written, with their batch; path must have been written to."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)


class Version:
    """A small table of which each batch makes a new version from the last one: a partition each, with a row that marks it, so that a
    version without rows is told from none. Batches see versions of smaller numbers only: a repeated one starts where it did."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._marked = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("live_", T.BooleanType())])

    def write(self, df: DataFrame, number: int) -> None:
        marker = self.spark.createDataFrame([tuple([None] * len(self.schema) + [False])], self._marked)
        once(df.select(*self.schema.names, F.lit(True).alias("live_")).union(marker), self.path, number)

    def number(self, before: int | None = None) -> int | None:
        rows = batches(self.spark, self.path, self._marked)
        return (rows if before is None else rows.where(F.col(BATCH) < before)).agg(F.max(BATCH)).first()[0]

    def read(self, before: int | None = None) -> DataFrame:
        """The last version, or the last of those before a batch."""
        number = self.number(before)
        return batches(self.spark, self.path, self._marked).where((F.col(BATCH) == F.lit(number)) & F.col("live_")).select(*self.schema.names)
