"""Filter interaction audit (13): what five filters remove in each of their 120 orders, from one SQL CUBE.

Every document gets five failure flags. Documents are first summed by part, flags and labels, then a CUBE over the flags and
the part gives, for each set of flags, the rows in which all of them are false: the documents that survive these filters,
whatever the others say. A step of an order is a pair of such sets, before and after its filter, so its figures are joins and
differences of survivors; documents are never read again for an order.

Copies (flag E) are found without a join by text: documents are summed by hash of the text and id, then by hash, so that a text
that a third of all rows share is combined before it moves. The hash is SHA-256.

Defined results: a null text is the empty text (it fails A, and E if a smaller id has an empty or null text); a null lang is
the part ''; a row without an id is never a copy, and no row is a copy of it; rows that repeat an id are documents of their own,
and copies of a smaller id only; a label counts if any of an id's label rows has it; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, written

FLAGS = "ABCDE"
ALL = (1 << len(FLAGS)) - 1
MEASURES = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The flags that a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good and toxic: documents summed by part, flags and labels."""
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.select("id", "part", F.sha2("text", 256).alias("key"), *[c.alias(k) for k, c in failures(F.col("text")).items()])
    own = ["A", "B", "C", "D"]
    each = slim.groupBy("key", "part", *own, "id").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    each = each.join(marks, "id", "left").select("key", "part", *own, "id", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # of each text, part and labels: all rows, those without an id, the smallest id and its rows
    kinds = each.groupBy("key", "part", *own, "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    first = kinds.groupBy("key").agg(F.min("least.id").alias("first"))
    kinds = kinds.join(first, "key").withColumn("alone", F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    copies = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("alone").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("n"))))
    rows = kinds.select("part", *own, "good", "toxic", copies.alias("x")).select("part", *own, "x.E", F.col("x.n").alias("n"), "good", "toxic")
    return rows.groupBy("part", *FLAGS).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(sums: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i of FLAGS) and the documents that fail none of its filters, for all subsets of each part."""
    cube = sums.cube(*FLAGS, "part").agg(*[F.sum(c).alias(c) for c in MEASURES], *[F.grouping(c).alias(f"no_{c}") for c in (*FLAGS, "part")])
    clean = cube.where("no_part = 0")
    for f in FLAGS:
        clean = clean.where((F.col(f"no_{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"no_{f}")) * (1 << i) for i, f in enumerate(FLAGS)), F.lit(0)).cast("int")
    clean = clean.select("part", subset.alias("subset"), *MEASURES)
    # a subset that nothing survives has no row of its own
    every = sums.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(clean, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES])


def steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of all orders: the sets of filters before and after each."""
    rows = []
    for order in permutations(FLAGS):
        before = 0
        for at, f in enumerate(order, 1):
            own = 1 << FLAGS.index(f)
            rows.append(("".join(order), at, f, own, before, before | own))
            before |= own
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, own int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: see the module."""
    left = written(survivors(written(flagged(docs, labels), "flags")), "survivors")

    def at(name: str, prefix: str) -> DataFrame:
        return left.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in MEASURES])

    orders = steps(docs.sparkSession)
    rows = orders.join(at("before", "b_"), "before").join(at("after", "a_"), ["part", "after"])
    # a filter alone, and all filters but it
    rows = rows.join(at("own", "o_").select("part", "own", "o_n"), ["part", "own"])
    rows = rows.withColumn("rest", F.lit(ALL) - F.col("own")).join(at("rest", "r_").select("part", "rest", "r_n"), ["part", "rest"])
    whole = left.groupBy("part").agg(F.sum(F.when(F.col("subset") == 0, F.col("n"))).alias("w_n"), F.sum(F.when(F.col("subset") == ALL, F.col("n"))).alias("c_n"))
    rows = rows.join(whole, "part").withColumn("removed", F.col("b_n") - F.col("a_n"))
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", F.col("a_n").alias("kept"), "removed", (F.col("w_n") - F.col("o_n") - F.col("removed")).alias("redundant"), (F.col("r_n") - F.col("c_n")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"), "shapley",
    )


def op13_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_cube": op13_filter_cube}
#: Applies the filters of each order one after another, without subsets.
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
least_id AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
w AS (SELECT d.*, m, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS ws FROM d JOIN least_id ON d.t = least_id.t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
  100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(w.doc_id > m, FALSE) AS E FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
fails AS (SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS bad,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
s AS (SELECT part, bad, n, good, toxic, o, k, substr(o, k, 1) AS x, len(regexp_extract_all(translate(substr(o, 1, k - 1), 'ABCDE', 'ABCDE'), CASE WHEN bad = '' THEN '[^A-E]' ELSE '[' || bad || ']' END)) > 0 AS gone
  FROM fails, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
g AS (SELECT part, o AS filter_order, k::INTEGER AS step, any_value(x) AS x,
  coalesce(sum(n) FILTER (NOT gone AND NOT contains(bad, x)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND contains(bad, x)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND contains(bad, x)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND contains(bad, x)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND contains(bad, x)), 0)::BIGINT AS toxic_lost FROM s GROUP BY part, o, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""
ORACLE_SQL = {"op13_filter_cube": _SQL}
