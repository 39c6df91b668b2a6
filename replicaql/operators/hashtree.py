"""Hash trees (Merkle trees) over ranges of keys, and the descent that finds where two replicas differ.

A key's place is its token, the SHA-256 of its text in hex; a range is a prefix of tokens, so both replicas cut alike whatever rows
they hold, and ranges are about equally full whatever the keys. The leaves, prefixes of depth digits, hash their rows in key
order; each level above hashes its (at most 16) children, up to the root of a group (a user). Only digests of rows move, once and as their 32
bytes (texts that are hashed hold them in hex, and roots come in hex), and
a group that holds most of the table is spread over its leaves: choose depth so that a leaf's digests fit in a task (leaf_depth).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

FANOUT = 16


def leaf_depth(rows: int, leaf_rows: int = 4096) -> int:
    """Digits for which a group of so many rows has leaves of about leaf_rows. Both replicas need one depth: take the larger group's."""
    return max(0, math.ceil(math.log(max(rows, 1) / leaf_rows, FANOUT)))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def token(key: str, depth: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, depth)


def leaves(df: DataFrame, columns: Sequence[str], key: str, by: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """by, prefix, n, hash (binary): SHA-256 of the row digests of each range, in key order (rows of a repeated key by digest)."""
    digest = _sha(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    rows = df.select(*by, token(key, depth).alias("prefix"), F.struct(F.col(key).alias("key"), digest.alias("digest")).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: _hex(x["digest"])), "")
    return rows.groupBy(*by, "prefix").agg(F.count("*").alias("n"), _sha(text).alias("hash"))


def folded(level: DataFrame, by: Sequence[str], digits: int) -> DataFrame:
    """The next level: ranges of so many digits from those of one more."""
    child = F.struct("prefix", "hash")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat(x["prefix"], F.lit(":"), _hex(x["hash"]))), ",")
    return level.groupBy(*by, F.substring("prefix", 1, digits).alias("up_")).agg(F.sum("n").alias("n"), _sha(text).alias("hash")).withColumnRenamed("up_", "prefix")


def roots(df: DataFrame, columns: Sequence[str], key: str, by: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """by, n, hash: the root of each group, in hex."""
    found = reduce(lambda level, digits: folded(level, by, digits), range(depth - 1, -1, -1), leaves(df, columns, key, by, depth)).drop("prefix")
    return found.withColumn("hash", _hex(F.col("hash")))


def tree(df: DataFrame, columns: Sequence[str], key: str, by: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """level (digits), by, prefix, n, hash (binary) of all levels, each written once by itself: a descent reads the levels it needs."""
    level = written(leaves(df, columns, key, by, depth), "leaves")
    levels = [level.withColumn("level", F.lit(depth))]
    for digits in range(depth - 1, -1, -1):
        level = written(folded(level, by, digits), "level")
        levels.append(level.withColumn("level", F.lit(digits)))
    return reduce(DataFrame.unionByName, levels)


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{c}_"]) for c in by], F.lit(True))


def differing(a: DataFrame, b: DataFrame, by: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """by, prefix: the leaves in which two trees differ, a range that one of them lacks included.

    Goes down level by level: of each level only the children of differing ranges are compared.
    """
    found = None
    for digits in range(depth + 1):
        sides = []
        for side in (a, b):
            level = side.where(F.col("level") == digits).select(*by, "prefix", "hash")
            if found is not None:
                up = found.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("prefix").alias("up_"))
                level = level.join(up, _same(level, up, by) & (F.substring(level["prefix"], 1, digits - 1) == F.col("up_")), "left_semi")
            sides.append(level)
        other = sides[1].select(*[F.col(c).alias(f"{c}_") for c in by], F.col("prefix").alias("prefix_"), F.col("hash").alias("hash_"))
        both = sides[0].join(other, _same(sides[0], other, by) & (F.col("prefix") == F.col("prefix_")), "full_outer")
        here = F.col("prefix").isNotNull()
        found = both.where(~F.col("hash").eqNullSafe(F.col("hash_"))).select(*[F.when(here, F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in by], F.coalesce("prefix", "prefix_").alias("prefix"))
    return found


def rows_in(df: DataFrame, ranges: DataFrame, key: str, by: Sequence[str] = (), depth: int = 2) -> DataFrame:
    """The rows of a replica that lie in the ranges: what a repair has to send."""
    rows = df.withColumn("range_", token(key, depth))
    wanted = ranges.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("prefix").alias("wanted_"))
    return rows.join(wanted, _same(rows, wanted, by) & (F.col("range_") == F.col("wanted_")), "left_semi").drop("range_")
