"""Line dedup (5), native: content-defined chunks of lines, removed where the corpus repeats them.

A chunk is a run of lines of at least WORDS words, as short as it can be: one from each line that is not blank onwards, and one up
to each such line. Its hash is made from the hashes of its lines. So a chunk's ends depend on its own lines alone and never on what
stands before or after a passage, and the chunks of a passage overlap: of lines with WORDS words or more that stand elsewhere
too, every line is met, wherever they stand, and fewer words are left however often they recur. Chunks are counted by hash over the corpus; texts
of chunks whose hash repeats are compared byte by byte, and all but the first occurrence (smallest id, text hash, line) of
equal chunks go. The first occurrence of a line is in no chunk that goes, so every line stays somewhere.

Boundaries where a rolling hash of the last two line hashes meets a divisor would make fewer chunks, but a passage of few lines
seldom holds a whole chunk (README has figures), so every line is taken for a boundary.

Defined results: a null text stays null; an empty text has one empty line; rows repeated with the same id and text
share their fate; equal chunks may overlap; blank lines before and after what goes stay; a text of which all lines go
becomes empty; an empty table gives an empty result; other columns, whatever their names, pass through, but for
n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, small, table, written

#: A chunk's words. Lines hold a word at least, so a chunk has at most so many that are not blank; most have few.
WORDS, FEW = 50, 8


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once a row even if f uses it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _run(held: Column, i: Column, step: int, lines: int, words: int) -> Column:
    """n, at and h of the lines of held from i on, forwards (step 1) or backwards: the words of the shortest run that has so many (fewer if
    these lines have fewer), the place of its last line, and its hash, which rolls over the hashes of its lines."""
    last = F.least(i + lines - 1, F.size(held) - 1) if step > 0 else F.greatest(i - lines + 1, F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("h"))

    def more(acc: Column, j: Column) -> Column:
        x = F.get(held, j)  # slices would copy the whole array each time
        return F.when(acc["n"] >= words, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), j.alias("at"), F.xxhash64(acc["h"], x["h"]).alias("h")))

    return F.aggregate(F.sequence(i, last, F.lit(step)), start, more)


def _runs(held: Column, step: int, words: int) -> Column:
    """The run from each line, or null; few lines are tried first. One up to a line that is also the one from its own first line is left out."""

    def chunk(i: Column, r: Column) -> Column:
        own, end = F.get(held, i), F.get(held, r["at"])
        found = F.struct(F.least(own["at"], end["at"]).alias("first"), (F.abs(end["at"] - own["at"]) + 1).alias("size"), F.xxhash64(r["h"], F.lit(step)).alias("h"))
        return F.when((r["n"] >= words) & (F.lit(step > 0) | (r["n"] - own["n"] >= words)), found)

    def run(x: Column, i: Column) -> Column:
        tried = _once(_run(held, i, step, FEW, words), lambda r: F.when(r["n"] >= words, r).otherwise(_run(held, i, step, words, words)))
        return _once(tried, lambda r: chunk(i, r))

    return F.transform(held, run)


def with_chunks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Adds cs: the chunks (first, size, h) of the column lines that may be removed."""
    held = F.filter(F.transform("lines", lambda x, i: F.struct(F.regexp_count(x, F.lit(WORD)).alias("n"), i.alias("at"), F.xxhash64(x).alias("h"))), lambda x: x["n"] > 0)
    return docs.withColumn("cs", _once(held, lambda v: F.filter(F.concat(_runs(v, 1, words), _runs(v, -1, words)), lambda c: c.isNotNull())))


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.transform(F.sequence(chunk["first"], chunk["first"] + chunk["size"] - 1), lambda j: F.get(lines, j)), "\n")


def repeated(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """_id, _key and gone: the (first, size) chunks to remove of each touched document."""
    lines = F.split("text", "\n", -1)
    base = docs.where("text is not null").select(F.col(id_col).alias("_id"), F.xxhash64("text").alias("_key"), lines.alias("lines"))
    rows = written(with_chunks(base).select("_id", "_key", F.inline("cs")), "chunks")
    often = rows.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    some = written(rows.join(often, "h"), "candidates")
    asked = some.groupBy("_id", "_key").agg(F.collect_set(F.struct("first", "size", "h")).alias("cs"))  # a document's own chunks
    near = small(written(asked, "asked"), F.lit(48) + 24 * F.size("cs")).withColumnsRenamed({"_id": "i", "_key": "k"})
    # texts are made inside the row: lines are not copied for each chunk
    chunks = lambda v: F.transform(v["cs"], lambda c: F.struct(c["first"].alias("first"), c["size"].alias("size"), c["h"].alias("h"), _text(v["lines"], c).alias("chunk")))
    texts = base.join(near, base["_id"].eqNullSafe(near["i"]) & (base["_key"] == near["k"])).select("_id", "_key", F.inline(_once(F.struct("lines", "cs"), chunks)))
    # equal bytes: grouped by the chunk itself; its digest then stands for it
    equal = texts.groupBy("h", "chunk").agg(F.count("*").alias("times"), F.min(F.struct("_id", "_key", "first")).alias("keep")).where("times > 1")
    equal = equal.select("h", F.sha2("chunk", 256).alias("digest"), "keep")
    all_rows = written(texts.select("_id", "_key", "first", "size", "h", F.sha2("chunk", 256).alias("digest")), "digests")
    gone = all_rows.join(equal, ["h", "digest"]).where(~F.struct("_id", "_key", "first").eqNullSafe(F.col("keep")))
    return gone.groupBy("_id", "_key").agg(F.collect_set(F.struct("first", "size")).alias("gone"))


def remove(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the repeated chunks cut from text, and n_lines and n_removed."""
    found = small(written(repeated(docs, id_col), "gone"), F.lit(48) + 16 * F.size("gone"))
    # the user's row stays whole in a struct, so that no name of its columns is in the way
    rows = docs.drop("n_lines", "n_removed").select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    joined = rows.join(found, F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_key")) & F.col("_text").isNotNull(), "left")
    lines = F.split("_text", "\n", -1)
    # chunks overlap: their lines as numbers, each once
    out = F.array_distinct(F.flatten(F.transform("gone", lambda c: F.sequence(c["first"], c["first"] + c["size"] - 1))))
    left = lambda v: F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["out"]), lambda i: F.get(v["lines"], i))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(out)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(_once(F.struct(lines.alias("lines"), out.alias("out")), left), "\n"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in kept], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


QUERIES = {"op5_line_chunks": op5_line_chunks}
ORACLE_SQL: dict[str, str] = {}
