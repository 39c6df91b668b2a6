"""The last-result sink: results of synchronisations, appended, and the last one of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pending operations and errors of a result are not stored.
RESULT = "user_id string, duration_ms long, synced long, failed long, conflicts_resolved long, bytes_pushed long, bytes_pulled long, was_skipped boolean, was_cancelled boolean, skip_reason string, at long"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def append(spark: SparkSession, path: str, result: dict, at: int) -> None:
    """Adds one result; what it leaves out is 0 or false. at orders a user's results."""
    reason = result.get("skip_reason")
    row = [str(result["user_id"]), *(int(result.get(c, 0)) for c in NAMES[1:7]), reason is not None, bool(result.get("was_cancelled", False)), reason, at]
    spark.createDataFrame([tuple(row)], RESULT).write.mode("append").parquet(path)


def last(spark: SparkSession, path: str) -> DataFrame:
    """Each user's last result, with the bytes of all results up to it (total_bytes_pushed, total_bytes_pulled)."""
    rest = NAMES[1:]
    totals = [F.sum(c).alias(f"total_{c}") for c in ("bytes_pushed", "bytes_pulled")]
    return spark.read.schema(RESULT).parquet(path).groupBy("user_id").agg(F.max_by(F.struct(*rest), "at").alias("x"), *totals).select("user_id", "x.*", *[f"total_{c}" for c in ("bytes_pushed", "bytes_pulled")])
