"""Replica reconciliation: conflict detection, resolvers, and the pull as one join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .changes import single

TAKE_LOCAL, TAKE_REMOTE, MERGE, ASK, ABORT = "takeLocal", "takeRemote", "merge", "askUser", "abort"
NONE, MISMATCH, DELETION, MODIFIED = "none", "userMismatch", "deletionConflict", "bothModified"

#: A resolver maps (local struct, remote struct, conflict kind) to a strategy column.
Resolver = Callable[[Column, Column, Column], Column]


def _writes() -> Column:
    """Rows of matched() whose remote or merged row is written."""
    return F.col("action").isin("create", "update", TAKE_REMOTE, MERGE)


def kind(user: Column | None = None) -> Column:
    """What a pair is: the first rule that holds. user: whose pull it is (the local row's user if not given)."""
    mine = F.col("l.user_id") if user is None else user
    l_gone, r_gone = F.col("l").isNull(), F.col("r").isNull()
    known = ~l_gone if user is None else F.lit(True)
    return (
        F.when(~r_gone & known & ~F.col("r.user_id").eqNullSafe(mine), MISMATCH).when(l_gone | r_gone, NONE)
        .when(F.col("l.is_deleted") != F.col("r.is_deleted"), DELETION).when(F.col("l.version") != F.col("r.version"), MODIFIED).otherwise(NONE)
    )


def _prefer(first: str, second: str, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), first).when(b.isNotNull(), second).otherwise(ABORT)


def local_priority(local: Column, remote: Column, kind: Column) -> Column:
    return _prefer(TAKE_LOCAL, TAKE_REMOTE, local, remote)


def remote_priority(local: Column, remote: Column, kind: Column) -> Column:
    return _prefer(TAKE_REMOTE, TAKE_LOCAL, remote, local)


def last_write_wins(local: Column, remote: Column, kind: Column) -> Column:
    """The larger version; of equal ones the remote row only if it was modified strictly later."""
    newer = (remote["version"] > local["version"]) | ((remote["version"] == local["version"]) & (remote["modified_at"] > local["modified_at"]))
    return F.when(local.isNull() | remote.isNull(), _prefer(TAKE_REMOTE, TAKE_LOCAL, remote, local)).when(newer, TAKE_REMOTE).otherwise(TAKE_LOCAL)


def merging(local: Column, remote: Column, kind: Column) -> Column:
    """Both sides are needed; the merge function is given to pull()."""
    return F.when(local.isNotNull() & remote.isNotNull(), MERGE).otherwise(ABORT)


def decided(choice: Column) -> Resolver:
    """A user's choices: a column of strategies; one whose side is missing aborts, none yet asks."""

    def resolve(local: Column, remote: Column, kind: Column) -> Column:
        lacks = ((choice == TAKE_LOCAL) & local.isNull()) | ((choice == TAKE_REMOTE) & remote.isNull()) | ((choice == MERGE) & (local.isNull() | remote.isNull()))
        return F.when(choice.isNull(), ASK).when(lacks, ABORT).otherwise(choice)

    return resolve


def matched(local: DataFrame, remote: DataFrame, user: object = None, resolver: Resolver = last_write_wins, key: str = "id", each: bool = False) -> DataFrame:
    """key, h, l, r, kind, action: every row of both replicas once, by one full outer join on (user_id, key), before which remote rows
    meet the holders of their keys.

    h is the local row with the remote row's user and key, r the remote row. l is what r is compared with: h, or where r is
    not its user's, the local row of the same key (of the smallest user, if each), to which it is a mismatch. each: every remote row is
    pulled for its own user, else all for one user (the local rows' own, if none is given). Action: keep for local rows without
    a remote one, else create, update, or the resolver's strategy. Keys that a replica repeats for a user fail the job.
    """
    names = ["user_id", key]
    single_user = not each and user is not None
    # by key alone: the row to which a remote row without a row of its own user is a mismatch; a key's rows are combined before they move
    holders = (local.where(F.col("user_id") == F.lit(user)) if single_user else local).groupBy(F.col(key).alias("held_")).agg(F.min_by(F.struct(*local.columns), "user_id").alias("m_"))
    there = single(remote.join(holders, F.col(key) == F.col("held_"), "left").drop("held_"), names, "a remote row")
    here = single(local, names, "a local row")
    a = here.select(F.struct(*local.columns).alias("h"), *[F.col(c).alias(f"h_{c}") for c in names])
    b = there.select(F.struct(*remote.columns).alias("r"), "m_", *[F.col(c).alias(f"r_{c}") for c in names])
    both = a.join(b, F.col("h_user_id").eqNullSafe(F.col("r_user_id")) & F.col(f"h_{key}").eqNullSafe(F.col(f"r_{key}")), "full_outer")
    foreign = ~F.col("r.user_id").eqNullSafe(F.lit(user)) if single_user else F.col("h").isNull()
    lead = F.when(F.col("r").isNull(), None).when(foreign, F.col("m_")).otherwise(F.col("h"))
    found = both.select(F.when(F.col("r").isNotNull(), F.col(f"r_{key}")).otherwise(F.col(f"h_{key}")).alias(key), "h", lead.alias("l"), "r")
    found = found.withColumn("kind", kind(F.lit(user)) if single_user else kind())
    plain = F.when(F.col("l").isNull(), "create").otherwise("update")
    action = F.when(F.col("r").isNull(), "keep").when(F.col("kind") == NONE, plain).otherwise(resolver(F.col("l"), F.col("r"), F.col("kind")))
    return found.withColumn("action", action)


def classify(local: DataFrame, remote: DataFrame, user: object = None, resolver: Resolver = last_write_wins, key: str = "id", each: bool = False) -> DataFrame:
    """key, l, r, kind, action: the remote rows of matched()."""
    return matched(local, remote, user, resolver, key, each).where("r is not null").select(key, "l", "r", "kind", "action")


def pull(found: DataFrame, merge: Callable[[Column, Column], Sequence[Column]] | None = None, key: str = "id") -> DataFrame:
    """The local table after a pull: what is written replaces the row of its user and key, local-only rows stay, nothing
    is deleted. found: the result of matched(). A pair that is to be merged fails the job if there is no merge function; merged rows
    keep the remote row's user and key."""
    columns = found.schema["h"].dataType.names
    if merge is None:
        # struct by field, so that the check is not pruned with a column
        fail = F.raise_error(F.concat(F.lit("no merge function for "), F.col(key).cast("string")))
        row = F.when(F.col("action") == MERGE, fail.cast(found.schema["r"].dataType)).otherwise(F.col("r"))
        row = F.struct(*[row[c].alias(c) for c in columns])
    else:
        merged = merge(F.col("l"), F.col("r"))
        place = {"user_id", key}
        row = F.struct(*[F.when((F.col("action") == MERGE) & F.lit(c not in place), m).otherwise(F.col(f"r.{c}")).alias(c) for c, m in zip(columns, merged, strict=True)])
    kept = F.when(_writes(), row).otherwise(F.col("h"))
    return found.select(kept.alias("x")).where("x is not null").select("x.*")


def resolutions(found: DataFrame, merge: Callable[[Column, Column], Sequence[Column]] | None = None, key: str = "id") -> DataFrame:
    """key, user_id (of the remote row), kind and resolution of each conflict of matched() or classify(): strategy, data (the row that it
    ends with, null if none does), requires_user_input and message (why it waits or aborts)."""
    lost = found.where((F.col("kind") != NONE) & F.col("r").isNotNull())
    row = lost.schema["r"].dataType
    merged = F.lit(None).cast(row) if merge is None else F.struct(*[m.alias(c) for c, m in zip(row.names, merge(F.col("l"), F.col("r")), strict=True)])
    is_ = lambda s: F.col("action") == s
    held = F.struct(*[F.col(f"l.{c}").alias(c) for c in row.names])
    data = F.when(is_(TAKE_LOCAL) & F.col("l").isNotNull(), held).when(is_(TAKE_REMOTE), F.col("r")).when(is_(MERGE), merged)
    where = F.concat(F.col("kind"), F.lit(" of "), F.col(key).cast("string"))
    message = F.when(is_(ASK), F.concat(where, F.lit(" needs a choice"))).when(is_(ABORT), F.concat(where, F.lit(" has no side to take")))
    return lost.select(key, F.col("r.user_id").alias("user_id"), "kind", F.struct(F.col("action").alias("strategy"), data.alias("data"), is_(ASK).alias("requires_user_input"), message.alias("message")).alias("resolution"))


def pull_metrics(sized: Sequence[str] | None = None) -> list[Column]:
    """What a pull of matched() rows comes to: conflicts_resolved (every conflict, however it ended), written, bytes_pulled
    (JSON characters of plain rows, of the columns sized or all), pulled (remote rows) and one count for each kind of conflict."""
    remote, conflict = F.col("r").isNotNull(), F.col("r").isNotNull() & (F.col("kind") != NONE)
    row = F.col("r") if sized is None else F.struct(*[F.col(f"r.{c}").alias(c) for c in sized])
    size = F.length(F.to_json(row, {"ignoreNullFields": "false"}))
    return [
        F.count_if(conflict).alias("conflicts_resolved"), F.count_if(_writes()).alias("written"), F.coalesce(F.sum(F.when(remote & ~conflict, size)), F.lit(0)).alias("bytes_pulled"),
        F.count_if(remote).alias("pulled"), *[F.count_if(conflict & (F.col("kind") == k)).alias(name) for k, name in ((MISMATCH, "user_mismatches"), (DELETION, "deletions"), (MODIFIED, "modifications"))],
    ]


def pull_counts(found: DataFrame) -> DataFrame:
    """One row of pull_metrics(), by a job of its own; observed_pull() has them from the write itself."""
    return found.agg(*pull_metrics())


def observed_pull(found: DataFrame, write: Callable[[DataFrame], None], merge: Callable[[Column, Column], Sequence[Column]] | None = None, key: str = "id", sized: Sequence[str] | None = None) -> dict[str, int]:
    """Writes the table after a pull and returns pull_metrics() of it, observed on the way: nothing is read twice.

    write gets pull()'s rows and must run one job over all of them, a write of a table.
    """
    seen = Observation()
    write(pull(found.observe(seen, *pull_metrics(sized)), merge, key))
    return seen.get
