"""Scalar helpers as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duration_text(micros: Column) -> Column:
    """A duration in microseconds by its largest unit: 2d 3h, 3h 4m, 4m 5s, 5s 6ms, 7ms or 8µs."""
    us = micros.cast("long")
    part = lambda unit, wrap: (F.expr("0") + F.floor(us / unit) % wrap).cast("string")
    ms, s, m, h, d = 1_000, 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
    whole = lambda unit: F.floor(us / unit).cast("string")
    return (
        F.when(us >= d, F.concat(whole(d), F.lit("d "), part(h, 24), F.lit("h"))).when(us >= h, F.concat(whole(h), F.lit("h "), part(m, 60), F.lit("m")))
        .when(us >= m, F.concat(whole(m), F.lit("m "), part(s, 60), F.lit("s"))).when(us >= s, F.concat(whole(s), F.lit("s "), part(ms, 1000), F.lit("ms")))
        .when(us >= ms, F.concat(whole(ms), F.lit("ms"))).otherwise(F.concat(us.cast("string"), F.lit("µs")))
    )


def exponential_delay(attempt: Column, base_ms: int = 1000, factor: float = 2.0, most_ms: int = 300_000) -> Column:
    return F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(factor), attempt - 1)).cast("long")


def linear_delay(attempt: Column, step_ms: int = 1000) -> Column:
    return (attempt * step_ms).cast("long")


def fixed_delay(attempt: Column, delay_ms: int = 1000) -> Column:
    return F.when(attempt.isNotNull(), F.lit(delay_ms)).cast("long")


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])


def normalised(kind: T.DataType, rename: Callable[[str], str]) -> T.DataType:
    """A type with the fields of all structs in it renamed, through arrays and maps."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rename(f.name), normalised(f.dataType, rename), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(normalised(kind.elementType, rename), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(normalised(kind.keyType, rename), normalised(kind.valueType, rename), kind.valueContainsNull)
    return kind


def deep_columns(df: DataFrame, rename: Callable[[str], str] = snake) -> DataFrame:
    """Columns and nested fields by another case; casts of structs go by position, so no data is touched."""
    return df.select(*[F.col(f"`{f.name}`").cast(normalised(f.dataType, rename)).alias(rename(f.name)) for f in df.schema.fields])


def iso_text(ts: Column) -> Column:
    """A timestamp as ISO-8601 text with milliseconds, as it reads in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def from_iso(text: Column) -> Column:
    """ISO-8601 text as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def new_id() -> Column:
    """A random UUID for each row."""
    return F.uuid()
