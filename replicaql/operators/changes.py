"""Row diffs, upserts, patches, the operation log, its replay, and retry outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key, change (create, update, delete, same), delta: changed columns as text by name, null if none changed, and full:
    the new row's columns, null for a delete. A key that a side repeats fails the job."""
    a, b = (single(df.select(*key, *columns), key, f"{what} row").select(*key, F.struct(*columns).alias(name)) for df, what, name in ((old, "an old", "o"), (new, "a new", "n")))
    both = a.join(b, list(key), "full_outer")
    changed = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("key"), F.col(f"n.{c}").cast("string").alias("value"))) for c in columns]
    delta = F.map_from_entries(F.filter(F.array(*changed), lambda x: x.isNotNull()))
    kind = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "delete").when(F.size(delta) > 0, "update").otherwise("same")
    return both.select(*key, kind.alias("change"), F.when(F.col("o").isNotNull() & F.col("n").isNotNull() & (F.size(delta) > 0), delta).alias("delta"), F.col("n").alias("full"))


def single(rows: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """rows, which fail the job if two have one key."""
    columns = [c for c in rows.columns if c not in key]
    one = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit(f"{what} twice for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))).cast("boolean")).otherwise(F.lit(True))
    found = rows.groupBy(*key).agg(F.first(F.struct(*columns)).alias("x_"), one.alias("one_")).where("one_")
    return found.select(*[F.col(c) if c in key else F.col(f"x_.{c}").alias(c) for c in rows.columns])


def upsert(base: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """base with rows put in by key; of several rows with a key the last by order stays, and without an order they fail."""
    if order is None:
        rows = single(rows, key, "a row")
    else:
        rows = rows.withColumn("n_", F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))).where("n_ = 1").drop("n_")
    return base.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def patch(base: DataFrame, deltas: DataFrame, key: Sequence[str], columns: Sequence[str], missing: str = "error") -> DataFrame:
    """Overlays deltas (key, delta map<string,string>): present keys replace, nulls included. A key with two deltas fails
    the job, and so does one without a row in base, unless missing is "ignore"."""
    if missing not in ("error", "ignore"):
        raise ValueError("missing is error or ignore")
    deltas = single(deltas.select(*key, "delta"), key, "a delta")
    joined = base.withColumn("there_", F.lit(True)).join(deltas, list(key), "left" if missing == "ignore" else "full_outer")
    lost = F.raise_error(F.concat(F.lit("no row to patch: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))).cast("boolean")
    joined = joined.where(F.when(F.col("there_").isNull(), lost).otherwise(F.lit(True)))
    kinds = dict(base.dtypes)
    for c in columns:
        joined = joined.withColumn(c, F.when(F.coalesce(F.map_contains_key("delta", F.lit(c)), F.lit(False)), F.get(F.array(F.col("delta")[c]), F.lit(0)).cast(kinds[c])).otherwise(F.col(c)))
    return joined.select(*base.columns)


def delete(base: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.join(keys.select(*key), list(key), "left_anti")


def deleted(base: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """key and went: whether a delete of the keys takes a row out."""
    there = base.select(*key).distinct().withColumn("went", F.lit(True))
    return keys.select(*key).distinct().join(there, list(key), "left").select(*key, F.coalesce("went", F.lit(False)).alias("went"))


def clear_user(base: DataFrame, user_id: object, column: str = "user_id") -> DataFrame:
    return base.where(~F.col(column).eqNullSafe(F.lit(user_id)))


def operation_log(changes: DataFrame, user: Column, seq: Column, now: Column) -> DataFrame:
    """Pending operations of a diff: op_id, type, delta, full, seq, retry_count and size (JSON characters)."""
    size = F.when(F.col("change") == "delete", F.length(F.to_json(F.struct("id")))).when(F.col("change") == "create", F.length(F.to_json("full"))).otherwise(F.length(F.to_json("delta")))
    return changes.where("change <> 'same'").select(F.concat_ws("-", F.lit("op"), seq.cast("string")).alias("op_id"), "id", user.alias("user_id"), F.col("change").alias("type"), "delta", "full", seq.alias("seq"), now.alias("at"), F.lit(0).alias("retry_count"), F.coalesce(size, F.lit(0)).alias("size"))


def push(base: DataFrame, rows: DataFrame, key: Sequence[str], columns: Sequence[str], user: Column, seq: Column, now: Column, source: str = "local", force: bool = False, before_save: Sequence = ()) -> tuple[DataFrame, DataFrame]:
    """Saving rows: the table with them put in, and the operations to queue (create or update).

    Rows go through before_save first. One whose columns equal those of the row that is there is not written and makes no
    operation, so no row changes without one. Rows that come from the remote side are saved but not queued, unless force.
    """
    if source not in ("local", "remote"):
        raise ValueError("sources are local and remote")
    rows = single(reduce(lambda df, step: df.transform(step), before_save, rows), key, "a row")
    found = diff(base.join(rows.select(*key), list(key), "left_semi"), rows, key, columns)
    log = operation_log(found, user, seq, now)
    changed = rows.join(found.where("change <> 'same'").select(*key), list(key), "left_semi")
    saved = base.join(changed.select(*key), list(key), "left_anti").unionByName(changed)
    return saved, log if source == "local" or force else log.limit(0)


def enqueue(queue: DataFrame, ops: DataFrame) -> DataFrame:
    """Puts operations in by op_id; one that is there keeps its place in the queue."""
    old = queue.select("op_id", F.col("seq").alias("old_seq"))
    placed = ops.join(old, "op_id", "left").withColumn("seq", F.coalesce("old_seq", "seq")).select(*ops.columns)
    return upsert(queue, placed, ["op_id"])


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return delete(queue, done, ["op_id"])


def hot_keys(ops: DataFrame, key: str, limit: int, parts: int) -> DataFrame:
    """key and bounds: of each key with more than limit operations, the seqs that cut them into about equal parts."""
    counts = ops.groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > limit).select(key)
    return ops.select(key, "seq").join(counts, key, "left_semi").groupBy(key).agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)], 1000).alias("bounds_"))


def runs(ops: DataFrame, columns: Sequence[str], key: str = "id", limit: int = 1_000_000, parts: int = 64) -> DataFrame:
    """Operations folded into runs: key, part (runs of a key in this order follow each other) and run, what the run does to any row.

    A run is an element of a monoid: it either sets the row whatever was there (sets: gone, or row), or it overlays columns
    (over: for each column whether and what it sets) and, where no row was, makes one (fresh). A key has one run, but one with
    more than limit operations has up to parts of them, cut by seq, so that no task gets all its operations.
    """
    kinds = dict(ops.select("full.*").dtypes)
    hot = hot_keys(ops, key, limit, parts)
    if not hot.isEmpty():
        ops = ops.join(hot, key, "left").withColumn("part_", F.coalesce(F.size(F.filter("bounds_", lambda b: b < F.col("seq"))), F.lit(0))).drop("bounds_")
    else:
        ops = ops.withColumn("part_", F.lit(0))
    w = W.partitionBy(key, "part_").orderBy("seq")
    is_delete, is_delta = F.col("type") == "delete", F.col("type").isin("update", "patch") & (F.coalesce(F.size("delta"), F.lit(0)) > 0)
    # a delta right behind a delete finds no row and is taken whole
    ops = ops.select(key, "part_", "seq", "full", "delta", is_delete.alias("delete_"), F.lag(is_delete).over(w).alias("after_"), is_delta.alias("delta_"))
    whole = ~F.col("delta_") | F.coalesce("after_", F.lit(False))
    first = F.min_by("full", "seq")
    found = ops.groupBy(key, "part_").agg(
        F.bool_or(whole).alias("sets"), F.max_by("delete_", "seq").alias("gone"), first.alias("first_"), F.min("seq").alias("first_seq"),
        *[F.max_by(F.struct("seq", _new_value(c, kinds[c], whole).alias("value")), F.when(whole | _touches(c), F.col("seq"))).alias(f"last_{c}") for c in columns],
    )
    value = lambda c: F.col(f"last_{c}.value")
    later = lambda c: F.coalesce(F.col(f"last_{c}.seq") > F.col("first_seq"), F.lit(False))
    run = F.struct(
        F.col("sets"), F.col("gone"), F.struct(*[value(c).alias(c) for c in columns]).alias("row"), F.struct(*[F.struct(F.col(f"last_{c}").isNotNull().alias("set"), value(c).alias("value")).alias(c) for c in columns]).alias("over"),
        F.struct(*[F.when(later(c), value(c)).otherwise(F.col("first_")[c]).alias(c) for c in columns]).alias("fresh"),
    )
    return found.select(key, F.col("part_").alias("part"), run.alias("run"))


def _touches(column: str) -> Column:
    return F.coalesce(F.map_contains_key("delta", F.lit(column)), F.lit(False))


def _new_value(column: str, kind: str, whole: Column) -> Column:
    return F.when(F.col("delete_"), None).when(whole, F.col("full")[column]).otherwise(F.get(F.array(F.col("delta")[column]), F.lit(0)).cast(kind))


def then(state: Column, run: Column, columns: Sequence[str]) -> Column:
    """The state (there, row) after a run."""
    overlaid = F.struct(*[F.when(run["over"][c]["set"], run["over"][c]["value"]).otherwise(state["row"][c]).alias(c) for c in columns])
    row = F.when(run["sets"], run["row"]).when(state["there"], overlaid).otherwise(run["fresh"])
    return F.struct(F.coalesce(~run["sets"] | ~run["gone"], F.lit(True)).alias("there"), row.alias("row"))


def replay(base: DataFrame, ops: DataFrame, columns: Sequence[str], key: str = "id", limit: int = 1_000_000, parts: int = 64) -> DataFrame:
    """The table after all operations, in seq order.

    ops: key, seq (unique for each key), type (create, update, patch, delete), full (struct of columns) and delta (map<string,string>);
    an update with an empty or null delta is a full one, and a delta where no row is makes the operation's full row. Operations are
    folded into runs() first, and a key's runs, at most parts of them, are applied to its row.
    """
    kinds = dict(base.dtypes)
    state = F.struct(F.col("b").isNotNull().alias("there"), F.struct(*[F.col(f"b.{c}").alias(c) for c in columns]).alias("row"))
    ops = ops.withColumn("full", F.struct(*[F.col(f"full.{c}").cast(kinds[c]).alias(c) for c in columns]))
    found = runs(ops, columns, key, limit, parts).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "run"))).alias("runs"))
    both = base.select(key, F.struct(*columns).alias("b")).join(found, key, "full_outer")
    end = F.aggregate(F.coalesce("runs", F.array().cast(found.schema["runs"].dataType)), state, lambda s, r: then(s, r["run"], columns))
    return both.select(key, end.alias("end")).where("end.there").select(key, *[F.col(f"end.row.{c}").alias(c) for c in columns])


def outcomes(attempts: DataFrame, max_retries: int = 3, should_retry: Column | None = None, backoff: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds outcome (synced, retry, dead) and the next retry_count. attempts: error (null if none), retryable, retry_count.

    should_retry: a test of an attempt's columns in place of retryable; one that is null doesn't retry. backoff: milliseconds to wait before
    the attempt of a number, any function of Columns; it adds delay_ms, null where nothing is retried.
    """
    wanted = F.coalesce(F.col("retryable") if should_retry is None else should_retry, F.lit(False))
    retry = F.col("error").isNotNull() & wanted & (F.col("retry_count") < max_retries)
    if backoff is not None:
        attempts = attempts.withColumn("delay_ms", F.when(retry, F.greatest(backoff(F.col("retry_count") + 1), F.lit(0))).cast("long"))
    return attempts.withColumn("outcome", F.when(F.col("error").isNull(), "synced").when(retry, "retry").otherwise("dead")).withColumn("retry_count", F.col("retry_count") + retry.cast("int"))
