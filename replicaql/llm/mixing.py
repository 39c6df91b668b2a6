"""Mixing sources to target weights (3): Sainte-Lague apportionment of equal-token blocks.

1. Each source's target is its share of all words by weight, capped at max_repeats times its size; what a cap cuts
   off is shared again by weight until no target is above its cap (a water level over sources).
2. A target is a number of whole passes over its source and a rest. Blocks of block words are seats for the rests:
   sources get seats by the highest Sainte-Lague quotients, then the hash shards of a source (about shard_words words
   each, so a hot source is many shards) get the source's seats the same way. The divisors behind the quotients are
   found by bisection over the tables of sources and of shards; ties go to the earlier source or shard.
3. A shard's documents in seeded order are one stream of words cut into blocks; a quota of q takes q blocks at equal steps
   from a seeded start, a last block that is not full only after all others. How many blocks before a place are taken is
   a quotient, so a document's words are counted without its blocks.

Rows with the same id, text and source are one document of that many copies, so a hot row is one row of the stream; its
copies share what it takes, to the word, and leave in parts of COPIES, dealt over tasks.

Defined results: a null text has size 0 and takes 0; null is a source of its own, last in order; repeated rows stay
separate rows; an empty table gives an empty result; other columns, whatever their names, pass through
mixed_documents(). Only sums and one row for each partition of sources reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, written

BLOCK_WORDS = 64
SHARD_WORDS = 100_000
SEED = 42
WAYS, ROUNDS = 24, 16  # divisors tried at once, and how often
FEW = 1_000  # quotients of a group that are ranked instead of divided further
COPIES = 10_000  # rows with more copies are dealt in parts of so many


def numbered(sources: DataFrame) -> DataFrame:
    """Adds no: the place of each source by code point, null last, from 0. One count for each partition is collected."""
    spread = sources.withColumn("_last", F.col("source").isNull()).repartitionByRange("_last", "source").sortWithinPartitions("_last", "source")
    held = written(spread.drop("_last").withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["n"]
    starts = sources.sparkSession.createDataFrame(offsets, "_p long, _before long")
    return held.join(F.broadcast(starts), part == F.col("_p")).withColumn("no", place + F.col("_before")).drop("_at", "_p", "_before")


def targets(sources: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """Adds target to rows of size and weight: shares of all sizes by weight, none above max_repeats times its size."""
    cap, level, before = F.col("size") * float(max_repeats), 0.0, -1.0
    while level > before:
        full = F.col("weight") * level > cap
        left, weights = sources.agg(F.sum("size") - F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weights:
            break
        before, level = level, max(level, float(left) / float(weights))
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def sainte_lague(rows: DataFrame, by: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """Adds quota: of each group's seats the ones that a row of so many votes gets by the quotients votes / (2 q + 1).

    A divisor d gives round(votes / d) seats. Several divisors are tried at once until one gives a group its seats, or FEW quotients at most,
    no two of a row, lie between two divisors: the highest of them get one more each. Of rows that tie the earlier do."""
    q = lambda d: F.floor(F.col(votes) / d + 0.5)
    rows = rows.withColumn(votes, F.col(votes).cast("double"))
    s = F.col(seats)
    range_ = rows.groupBy(*by).agg(F.sum(votes).alias("_v"), F.max(votes).alias("_most"), F.count("*").alias("_n"), F.max(seats).alias(seats))
    # Webster's divisors: the sum of roundings is within half a seat a row
    low = F.col("_v") / (s + F.col("_n") / 2 + 1)
    high = F.when(s > F.col("_n") / 2 + 1, F.least(F.col("_v") / (s - F.col("_n") / 2 - 1), F.col("_most") * 2 + 1)).otherwise(F.col("_most") * 2 + 1)
    range_ = written(range_.where(f"_v > 0 and {seats} > 0").select(*by, seats, low.alias("_lo"), high.alias("_hi"), F.lit(False).alias("_found")), "divisors")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    for _ in range(ROUNDS):
        if range_.where("not _found").isEmpty():
            break
        todo = range_.where("not _found")
        at = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / F.lit(WAYS - 1))
        ways = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda i: F.struct(at(i).alias("d"), at(i + 1).alias("next"))))
        tried = rows.drop(seats).join(todo, same(rows, todo)).select(*[todo[c] for c in by], votes, seats, "_lo", "_hi", ways.alias("_i", "_way"))
        now, after = q(F.col("_way.d")), q(F.col("_way.next"))
        tried = tried.groupBy(*by, "_i").agg(*[F.first(c).alias(c) for c in (seats, "_lo", "_hi")], F.first("_way.d").alias("_d"), F.sum(now).alias("_sum"), F.max(now - after).alias("_step"))
        given = F.col("_sum")
        tried = tried.groupBy(*by).agg(
            *[F.first(c).alias(c) for c in (seats, "_lo", "_hi")], F.min(F.when(given == s, F.col("_d"))).alias("_exact"),
            F.max(F.when(given > s, F.col("_d"))).alias("_above"), F.min(F.when(given < s, F.col("_d"))).alias("_below"),
            (F.min(F.when(given > s, given)) - F.max(F.when(given < s, given))).alias("_open"), F.max_by("_step", F.when(given > s, F.col("_d"))).alias("_step"),
        )
        # between two divisors a few rows have one quotient each: these are ranked below
        ranked = F.coalesce((F.col("_step") <= 1) & (F.col("_open") <= FEW), F.lit(False))
        lo, hi = F.greatest("_lo", "_above"), F.least("_hi", "_below")
        tried = tried.select(*by, seats, F.coalesce("_exact", lo).alias("_lo"), F.coalesce("_exact", hi).alias("_hi"), (F.col("_exact").isNotNull() | ranked).alias("_found"))
        range_ = written(range_.where("_found").unionByName(tried), "divisors")
    bounds = range_.drop(seats).withColumnsRenamed({c: f"_by_{c}" for c in by})
    placed = rows.join(bounds, [rows[c].eqNullSafe(bounds[f"_by_{c}"]) for c in by], "left").drop(*[f"_by_{c}" for c in by])
    placed = placed.withColumn("_q", F.coalesce(q(F.col("_hi")), F.lit(0)))
    given = placed.groupBy(*by).agg((F.max(seats) - F.sum("_q")).alias("_extra")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    tied = placed.where(q(F.col("_lo")) > F.col("_q")).withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.col(votes) / (2 * F.col("_q") + 1)), order)))
    more = tied.join(given, [tied[c].eqNullSafe(given[f"_by_{c}"]) for c in by]).where("_place <= _extra").select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(order).alias("_order"))
    won = placed.join(more, [placed[c].eqNullSafe(more[f"_by_{c}"]) for c in by] + [placed[order] == more["_order"]], "left")
    return won.withColumn("quota", F.col("_q") + F.when(F.col("_order").isNotNull(), 1).otherwise(0)).drop("_lo", "_hi", "_found", "_q", "_order", *[f"_by_{c}" for c in by])


def taken_before(at: Column, block: int) -> Column:
    """Words taken of a shard's first `at` words. Of n full blocks, block k is among the q taken if (k + turn) q / n and
    (k + 1 + turn) q / n differ in their whole parts, which q of any n neighbours do."""
    share = F.least("quota", "full")
    passed = lambda k: F.call_function("div", (F.least(k, F.col("full")) + F.col("turn")) * share, F.greatest(F.lit(1), "full"))
    k = F.call_function("div", at, F.lit(block))
    begun = F.when(k < F.col("full"), passed(k + 1) > passed(k)).otherwise(F.col("quota") > F.col("full"))
    return (passed(k) - passed(F.lit(0))) * block + F.when(begun, at - k * block).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, max_repeats: int = 3) -> DataFrame:
    """id, source, text_key, size, source_size, target, rows (how many are equal) and taken (words of all of them)."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64("text").alias("text_key"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("size"),
    )
    slim = written(slim.groupBy("id", "source", "text_key", "size").agg(F.count("*").alias("rows")), "sizes")
    sources = numbered(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights)).cast("int"))
    sources = targets(sources.withColumn("weight", weight), max_repeats)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    sources = written(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("size")), "targets")
    total = sources.agg(F.sum("rest")).first()[0] or 0.0
    held = sources.withColumn("_all", F.lit(0)).withColumn("seats", F.lit(round(total / block)).cast("long"))
    held = sainte_lague(held, ["_all"], "rest", "seats", "no").select("source", F.col("no").alias("source_no"), F.col("size").alias("source_size"), "target", "whole", F.col("quota").alias("seats"), F.greatest(F.lit(1), F.round(F.col("size") / shard_words)).cast("long").alias("shards"))
    held = written(held.withColumnRenamed("source", "source_"), "seats")
    placed = slim.join(held, slim["source"].eqNullSafe(held["source_"])).drop("source_")
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), "id", "text_key")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "text_key"), F.col("shards")))
    shards = written(placed.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("shard_size"), F.max("seats").alias("seats")), "shards")
    quotas = sainte_lague(shards.withColumn("votes", F.col("shard_size")), ["source_no"], "votes", "seats", "shard").select("source_no", "shard", "shard_size", "quota")
    long = F.col("size") * F.col("rows")
    stream = W.partitionBy("source_no", "shard").orderBy("order", "id", "text_key", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum(long).over(stream)).withColumn("start", F.col("end") - long)
    placed = placed.join(quotas, ["source_no", "shard"], "left")
    full = F.floor(F.col("shard_size") / block)  # blocks that are full; one more may not be
    placed = placed.withColumn("full", full).withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.greatest(F.lit(1), "full")))
    part = taken_before(F.col("end"), block) - taken_before(F.col("start"), block)
    taken = F.when(F.col("size") > 0, long * F.col("whole") + F.when(F.col("whole") < max_repeats, part).otherwise(0)).otherwise(0).cast("long")
    return placed.select("id", "source", "text_key", "size", "source_size", "target", "rows", taken.alias("taken"))


def mixed_rows(plan: DataFrame) -> DataFrame:
    """One row for each row that was mixed: equal ones share the words that they take."""
    plan = written(plan, "plan")
    few = plan.where(F.col("rows") <= COPIES).withColumn("_from", F.lit(0).cast("long"))
    many = plan.where(F.col("rows") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long"))))
    parts = few.unionByName(many.repartition("id", "text_key", "source", "_from"))
    each = parts.withColumn("no", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + COPIES, "rows"))))
    return each.withColumn("taken", F.floor(F.col("taken") / F.col("rows")) + F.when(F.col("no") <= F.col("taken") % F.col("rows"), 1).otherwise(0)).drop("no", "rows", "_from")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix as whole documents: a row is repeated taken/size times, the fraction rounded by a draw that is seeded by
    the whole row, so rows that are equal in all columns share it."""
    plan = mix(docs, id_col, source_col, seed=seed, **options).where("taken > 0")
    share = plan.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), (F.col("taken") / F.col("rows") / F.col("size")).alias("_share"))
    rows = docs.select(F.struct("*").alias("_row"))
    mine = F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_key")) & F.col(f"_row.{source_col}").cast("string").eqNullSafe(F.col("_source"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), *[F.col("_row")[c] for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]), F.lit(1_000_003)) / 1_000_003
    copies = F.floor(F.col("_share") + draw).cast("int")
    joined = rows.join(share, mine).withColumn("_copies", copies).where("_copies > 0")
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


def op3_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixed_rows(mix(table(spark, sf_dir, "documents")))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op3_sainte_lague": op3_sainte_lague}
ORACLE_SQL: dict[str, str] = {}
