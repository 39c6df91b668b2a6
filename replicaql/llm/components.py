"""Connected components of a link table, by label propagation with pointer jumping over written tables.

Defined results: links may repeat, run either way or from a node to itself (then it is in the result, alone if nothing else
links it); links with a null end must not be given; no links, no rows. Other columns of links are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """links: a, b (longs). Returns node, comp: the smallest node that links reach. Nothing but counts reaches the driver."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        after = written(low.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            return labels
