"""Offset pages and keyset cursors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 50


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total_count: int
    current_page: int
    total_pages: int
    next_cursor: object = None

    @property
    def has_more(self) -> bool:
        return self.current_page < self.total_pages


def page_rows(df: DataFrame, key: Sequence[str], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return df.orderBy(*key).offset((page - 1) * size).limit(size)


def page(df: DataFrame, key: Sequence[str], page: int | None = None, size: int = PAGE_SIZE) -> Page:
    page = page or 1
    total = df.count()
    return Page(page_rows(df, key, page, size), total, page, ceil(total / size))


def summary(df: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """total_count, total_pages and has_more as one row."""
    pages = F.ceil(F.col("total_count") / size).cast("long")
    return df.agg(F.count("*").alias("total_count")).withColumn("total_pages", pages).withColumn("has_more", F.lit(page) < F.col("total_pages"))


def after(df: DataFrame, key: str | Sequence[str], cursor: object = None, size: int = PAGE_SIZE, descending: Sequence[bool] = ()) -> DataFrame:
    """The next rows behind a cursor (the last key, or keys, seen): pruned by the keys, no offset. Keys hold no nulls and
    are unique together; descending says of each which way it runs."""
    keys = [key] if isinstance(key, str) else list(key)
    down = [*descending, *[False] * (len(keys) - len(descending))]
    if cursor is not None:
        at = [cursor] if isinstance(key, str) else list(cursor)
        beyond = F.lit(False)
        for k, v, d in reversed(list(zip(keys, at, down, strict=True))):
            further = F.col(k) < F.lit(v) if d else F.col(k) > F.lit(v)
            beyond = further | ((F.col(k) == F.lit(v)) & beyond)
        first = F.col(keys[0]) <= F.lit(at[0]) if down[0] else F.col(keys[0]) >= F.lit(at[0])
        df = df.where(first & beyond)  # the first key alone prunes files
    return df.orderBy(*[F.col(k).desc() if d else F.col(k).asc() for k, d in zip(keys, down, strict=True)]).limit(size)


def cursor_page(df: DataFrame, key: Sequence[str], cursor: Sequence | None = None, size: int = PAGE_SIZE, descending: Sequence[bool] = ()) -> tuple[list, tuple | None]:
    """A page's rows (at most size reach the driver) and the cursor behind them, None at the end."""
    rows = after(df, key, cursor, size + 1, descending).collect()
    more = len(rows) > size
    return rows[:size], tuple(rows[size - 1][k] for k in key) if more else None
