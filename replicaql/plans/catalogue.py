"""Registered queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changes, entity, hashtree, integrity, metrics, migrate, paging, rawscan, reconcile, relations, results, writesync
from ..operators.relations import BelongsTo, HasMany, HasOne, ManyToMany
from ..sources import adapter, scratch
from ..streaming import deltas, external, live
from ..streaming.sink import Version
from .compiler import apply, count, first
from .model import Filter, Logic, Op, Query, QueryBuilder
from .sqlgen import duckdb_sql

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _model(name: str, source: str, query: Query, columns: str, key: tuple[str, ...] = ()) -> None:
    """A query of the model; source is SQL that both engines read."""
    _SQL[name] = duckdb_sql(query, f"({source})", columns, key)

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _view(spark, d, source)
        return apply(df, query, key).select(*[c.strip() for c in columns.split(",")])

    _QUERIES[name] = run


def _view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """SQL over the tables it names, without views that outlive it."""
    names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels") if f" {t}" in f" {sql} "]
    named = re.sub(r"(?<=from )\w+", lambda m: "{" + m[0] + "}" if m[0] in names else m[0], sql)
    return spark.sql(named, **{t: _t(spark, d, t) for t in names})


def _q(**options) -> QueryBuilder:
    return QueryBuilder(**options)


_ORDERS, _PART, _CUST = "select * from orders", "select * from part", "select * from customer"
_O, _P, _C = "o_orderkey, o_orderstatus, o_totalprice", "p_partkey, p_name", "c_custkey, c_name"
_SEGMENTS = "select c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') as segment from customer"
_WORDS = "select p_partkey, p_name, split(p_name, ' ') as words from part"

_model("q_flagship", _ORDERS, _q().where("o_orderstatus", eq="O").any_of([Filter("o_orderpriority", Op.IN, ("1-URGENT", "2-HIGH")), Filter("o_totalprice", Op.GT, 200000.0)]).order_by("o_totalprice", True).limit(10).offset(20).build(), "o_orderkey, o_totalprice, o_orderpriority", ("o_orderkey",))
_model("f_equals", _ORDERS, _q().where("o_orderstatus", eq="O").build(), _O)
_model("f_not_equals", _ORDERS, _q().where("o_orderstatus", ne="O").build(), _O)
_model("f_gt", _ORDERS, _q().where("o_totalprice", gt=150000.0).build(), _O)
_model("f_gte", _ORDERS, _q().where("o_totalprice", ge=150000.0).build(), _O)
_model("f_lt", _ORDERS, _q().where("o_totalprice", lt=20000.0).build(), _O)
_model("f_lte", _ORDERS, _q().where("o_totalprice", le=20000.0).build(), _O)
_model("f_between", _ORDERS, _q().where("o_totalprice", between=[50000.0, 60000.0]).build(), _O)
_model("f_contains", _PART, _q().where("p_name", contains="e").build(), _P)
_model("f_contains_ci", _PART, _q().where("p_name", contains_ci="A").build(), _P)
_model("f_starts", _PART, _q().where("p_name", starts="s").build(), _P)
_model("f_ends", _CUST, _q().where("c_name", ends="7").build(), _C)
_model("f_matches", _CUST, _q().where("c_name", matches="[0-9]*[13]5$").build(), _C)
_model("f_in", _CUST, _q().where("c_mktsegment", is_in=["BUILDING", "MACHINERY"]).build(), "c_custkey, c_mktsegment")
_model("f_not_in", _SEGMENTS, _q().where_raw(Filter("segment", Op.NOT_IN, ("MACHINERY", None))).build(), "c_custkey, segment")
_model("f_in_empty", _CUST, _q().where_raw(Filter("c_mktsegment", Op.IN, ())).build(), _C)
_model("f_not_in_empty", _SEGMENTS, _q().where_raw(Filter("segment", Op.NOT_IN, ())).build(), "c_custkey, segment")
_model("f_is_null", _SEGMENTS, _q().where_null("segment").build(), "c_custkey, c_name")
_model("f_is_not_null", _SEGMENTS, _q().where_not_null("segment").build(), "c_custkey, segment")
_model("f_equals_null", _SEGMENTS, _q().where_raw(Filter("segment", Op.EQ, None)).build(), "c_custkey, segment")
_model("f_not_equals_null", _SEGMENTS, _q().where_raw(Filter("segment", Op.NE, None)).build(), "c_custkey, segment")
_model("f_or_root", _ORDERS, _q(logic=Logic.OR).where("o_orderstatus", eq="F").where("o_totalprice", gt=300000.0).build(), _O)
_model("f_composite_or", _ORDERS, _q().where("o_orderstatus", eq="O").any_of([Filter("o_totalprice", Op.LT, 10000.0), Filter("o_totalprice", Op.GT, 250000.0)]).build(), _O)
_model("f_composite_and_in_or", _ORDERS, _q(logic=Logic.OR).where("o_totalprice", gt=300000.0).all_of([Filter("o_orderstatus", Op.EQ, "P"), Filter("o_totalprice", Op.LT, 50000.0)]).build(), _O)
_model("q_sort_multi", _ORDERS, _q().order_by("o_orderpriority", True).order_by("o_totalprice").limit(25).build(), "o_orderkey, o_orderpriority, o_totalprice", ("o_orderkey",))
_model("q_nulls_first", _SEGMENTS, _q().order_by("segment", nulls_first=True).limit(40).build(), "c_custkey, segment", ("c_custkey",))
_model("q_nulls_last_desc", _SEGMENTS, _q().order_by("segment", True).limit(40).build(), "c_custkey, segment", ("c_custkey",))
_model("q_topk", _ORDERS, _q().order_by("o_totalprice", True).limit(15).build(), _O, ("o_orderkey",))
_model("q_offset_limit", _ORDERS, _q().order_by("o_totalprice", True).offset(30).limit(15).build(), _O, ("o_orderkey",))


@_register("f_array_contains", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'plate')")
def _(spark, d):
    return apply(_view(spark, d, _WORDS), _q().where("words", array_contains="plate").build()).select("p_partkey", "p_name")


@_register("f_array_contains_any", "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['plate', 'ring'])")
def _(spark, d):
    return apply(_view(spark, d, _WORDS), _q().where("words", array_any=["plate", "ring"]).build()).select("p_partkey", "p_name")


@_register(
    "f_within_distance",
    "WITH g AS (SELECT c_custkey, radians(c_custkey % 180 - 90) la, radians(c_custkey % 360 - 180) lo FROM customer), h AS (SELECT c_custkey, power(sin((radians(1.0) - la) / 2), 2) + cos(la) * cos(radians(1.0)) * power(sin((radians(-91.0) - lo) / 2), 2) a FROM g) "
    "SELECT c_custkey FROM h WHERE 6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) <= 3000000.5",
)
def _(spark, d):
    df = _t(spark, d, "customer").select("c_custkey", F.struct((F.col("c_custkey") % 180 - 90).alias("latitude"), (F.col("c_custkey") % 360 - 180).alias("longitude")).alias("place"))
    return apply(df, _q().where_within("place", 1.0, -91.0, 3_000_000.5).build()).select("c_custkey")


@_register("f_nested_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def _(spark, d):
    df = _t(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return apply(df, _q().where("props.k", ge=50).build()).select("event_id")


@_register("f_custom", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 AND o_orderstatus = 'O'")
def _(spark, d):
    hook = lambda f: F.col(f.field) % 7 == f.value if f.op is Op.MATCHES else None
    return apply(_t(spark, d, "orders"), _q().where("o_orderkey", matches=3).where("o_orderstatus", eq="O").build(), custom=hook).select("o_orderkey")


@_register("q_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return paging.page_rows(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 3)


@_register("q_page_summary", "SELECT count(*) total_count, CAST(ceil(count(*) / 50.0) AS BIGINT) total_pages, 3 < ceil(count(*) / 50.0) has_more FROM orders")
def _(spark, d):
    return paging.summary(_t(spark, d, "orders"), 3)


@_register("q_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def _(spark, d):
    return paging.after(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@_register("q_scan_user", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7")
def _(spark, d):
    return entity.scan(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), 7)


@_register("q_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def _(spark, d):
    return entity.lookup(_t(spark, d, "orders"), 77, "o_orderkey").select("o_orderkey", "o_custkey")


@_register("q_lookup_many", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    ids = _t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return entity.lookup_many(_t(spark, d, "orders"), ids, "o_orderkey").select("o_orderkey", "o_custkey")


@_register("q_scope_incremental", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, d):
    return entity.scoped(_t(spark, d, "events"), _q().where("ts", gt=datetime(2024, 1, 15)).limit(1).build()).select("event_id", "user_id")


@_register("r_belongs_to", "SELECT o_orderkey AS parent_key, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    parents = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    related = _t(spark, d, "customer").select("c_custkey", "c_name")
    return relations.pairs(parents, BelongsTo("o_custkey", "c_custkey"), related, parent_id="o_orderkey")


@_register("r_belongs_to_fetch", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(spark, d):
    return relations.fetch(_t(spark, d, "orders").where("o_totalprice > 250000"), BelongsTo("o_custkey", "c_custkey"), _t(spark, d, "customer")).select("c_custkey", "c_name")


@_register("r_has_many", "SELECT c_custkey AS parent_key, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0")
def _(spark, d):
    parents = _t(spark, d, "customer").where("c_acctbal < 0")
    return relations.pairs(parents, HasMany("o_custkey", "c_custkey"), _t(spark, d, "orders")).select("parent_key", "o_orderkey", "o_totalprice")


@_register("r_has_one", "SELECT d.doc_id AS parent_key, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return relations.pairs(_t(spark, d, "documents").select("doc_id"), HasOne("doc_id", "doc_id"), _t(spark, d, "labels"), order=("quality", "toxic")).select("parent_key", "quality", "toxic")


@_register("r_many_to_many", "SELECT o_orderkey AS parent_key, p_partkey, p_name FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'")
def _(spark, d):
    parents = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    return relations.pairs(parents, ManyToMany("l_orderkey", "l_partkey", "o_orderkey", "p_partkey"), _t(spark, d, "part"), _t(spark, d, "lineitem")).select("parent_key", "p_partkey", "p_name")


@_register("r_many_to_many_fetch", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 5)")
def _(spark, d):
    parent = _t(spark, d, "orders").where("o_orderkey = 5")
    return relations.fetch(parent, ManyToMany("l_orderkey", "l_partkey", "o_orderkey", "p_partkey"), _t(spark, d, "part"), _t(spark, d, "lineitem")).select("p_partkey", "p_name")


@_register("r_batch_counts", "SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    return entity.counts(_t(spark, d, "orders"), "o_custkey")


@_register("a_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    return count(_t(spark, d, "orders"), _q().where("o_orderstatus", eq="O").build())


@_register("a_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(spark, d):
    return first(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), _q().order_by("o_totalprice", True).build(), ("o_orderkey",))


@_register("a_distinct_users", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    return entity.users(_t(spark, d, "events"))


@_register("a_pending_count", "SELECT user_id, count(*) AS pending FROM events WHERE event_type <> 'view' GROUP BY user_id")
def _(spark, d):
    return _t(spark, d, "events").where("event_type <> 'view'").transform(entity.counts, name="pending")


@_register("a_entity_counts", "SELECT user_id, sum(o) AS orders, sum(e) AS events FROM (SELECT o_custkey AS user_id, 1 AS o, 0 AS e FROM orders UNION ALL SELECT user_id, 0, 1 FROM events) GROUP BY user_id")
def _(spark, d):
    meta = integrity.metadata({"orders": _t(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), "events": _t(spark, d, "events")}, F.lit(0))
    n = lambda k: F.coalesce(F.try_element_at("entity_counts", F.lit(k)), F.lit(0))
    return meta.select("user_id", n("orders").cast("decimal(38,0)").alias("orders"), n("events").cast("decimal(38,0)").alias("events"))


_SYNC = "select user_id, case event_id % 5 when 0 then 'started' when 1 then 'completed' when 2 then 'error' when 3 then 'conflictResolved' else 'userSwitched' end as event_type, event_id % 3 as failed_count, event_id % 4 as conflicts_resolved, event_id % 1000 as bytes_pushed, event_id % 700 as bytes_pulled, event_id % 90 as duration_ms, event_id from events"
_FOLD = "SELECT {by}count(*) FILTER (event_type = 'started') total_syncs, count(*) FILTER (event_type = 'completed' AND failed_count = 0) successful_syncs, count(*) FILTER (event_type = 'completed' AND failed_count > 0) + count(*) FILTER (event_type = 'error') failed_syncs, CAST(coalesce(sum(conflicts_resolved) FILTER (event_type = 'completed'), 0) AS BIGINT) conflicts_detected, count(*) FILTER (event_type = 'conflictResolved') conflicts_resolved, count(*) FILTER (event_type = 'userSwitched') user_switches, CAST(coalesce(sum(bytes_pushed) FILTER (event_type = 'completed'), 0) AS BIGINT) bytes_pushed, CAST(coalesce(sum(bytes_pulled) FILTER (event_type = 'completed'), 0) AS BIGINT) bytes_pulled, count(DISTINCT user_id) FILTER (event_type = 'started') active_users FROM (" + _SYNC + ")"


@_register("a_metrics_fold", _FOLD.format(by=""))
def _(spark, d):
    return metrics.fold_events(_view(spark, d, _SYNC))


@_register("a_statistics", f"SELECT user_id, count(*) total_syncs, count(*) FILTER (failed_count = 0) successful, count(*) FILTER (failed_count <> 0) failed, CAST(sum(conflicts_resolved) AS BIGINT) conflicts, avg(duration_ms) average_ms, CAST(sum(duration_ms) AS BIGINT) total_ms FROM ({_SYNC}) GROUP BY user_id")
def _(spark, d):
    return metrics.statistics(_view(spark, d, _SYNC), ["user_id"])


@_register("a_success_rate", f"SELECT user_id, CASE WHEN s + f = 0 THEN 100.0 ELSE s * 100.0 / (s + f) END::DOUBLE AS rate FROM (SELECT user_id, count(*) FILTER (event_type = 'completed' AND failed_count = 0) s, count(*) FILTER (event_type = 'error') f FROM ({_SYNC}) GROUP BY user_id)")
def _(spark, d):
    s, f = F.count_if((F.col("event_type") == "completed") & (F.col("failed_count") == 0)), F.count_if(F.col("event_type") == "error")
    return _view(spark, d, _SYNC).groupBy("user_id").agg(s.alias("s"), f.alias("f")).select("user_id", metrics.success_rate(F.col("s").cast("double"), F.col("f").cast("double")).alias("rate"))


@_register("a_storage_size", "SELECT CAST(sum(length('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}')) + count(*) - 1 + 2 AS BIGINT) AS size FROM customer")
def _(spark, d):
    return entity.storage_size(_t(spark, d, "customer").select("c_custkey", "c_name"))


@_register("a_rollup_totals", "SELECT user_id, event_type, count(*) items, CAST(sum(event_id % 100) AS BIGINT) bytes FROM events GROUP BY ROLLUP (user_id, event_type)")
def _(spark, d):
    return metrics.totals(_t(spark, d, "events").withColumn("size", F.col("event_id") % 100), "user_id", "event_type", "size")


@_register("a_startup_totals", "SELECT user_id, entity, count(bytes) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(sum(waits) AS BIGINT) AS pending FROM (SELECT o_custkey AS user_id, 'orders' AS entity, length(o_orderstatus) AS bytes, 0 AS waits FROM orders UNION ALL SELECT user_id, 'events', length(event_type), 0 FROM events UNION ALL SELECT user_id, 'events', NULL, 1 FROM events WHERE event_type <> 'view') GROUP BY ROLLUP (user_id, entity)")
def _(spark, d):
    """Items, bytes and pending operations before a synchronisation."""
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("payload"))
    events = _t(spark, d, "events").select("user_id", F.col("event_type").alias("payload"))
    return metrics.startup({"orders": orders, "events": events}, {"events": events.where("payload <> 'view'")}, lambda df: F.length("payload"))


@_register("a_running_bytes", "SELECT event_id, user_id, CAST(sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) total_bytes FROM events")
def _(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 100).alias("size"))
    return metrics.running_bytes(rows, "user_id", "event_id", "size").select("event_id", "user_id", "total_bytes")


@_register("a_durations", "SELECT event_id, CASE WHEN m >= 60000 THEN (m // 60000) || 'm ' || (m // 1000 % 60) || 's' WHEN m >= 1000 THEN (m // 1000) || 's ' || (m % 1000) || 'ms' ELSE m || 'ms' END AS took FROM (SELECT event_id, 1 + event_id * 37 % 200000 AS m FROM events)")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", scalars.duration_text((1 + F.col("event_id") * 37 % 200000) * 1000).alias("took"))


@_register("a_backoff", "SELECT event_id, CAST(least(300000.0, 1000 * power(2.0, n - 1)) AS BIGINT) exponential, n * 1000 AS linear FROM (SELECT event_id, 1 + event_id % 12 AS n FROM events)")
def _(spark, d):
    n = 1 + F.col("event_id") % 12
    return _t(spark, d, "events").select("event_id", scalars.exponential_delay(n).alias("exponential"), scalars.linear_delay(n).alias("linear"))


_LOCAL = "select o_orderkey as id, o_custkey as user_id, o_totalprice as amt, 1 + (o_orderkey % 3) as version, (o_orderkey % 11 = 0) as is_deleted, o_orderkey % 50 as modified_at from orders where o_orderkey % 10 <> 0"
_REMOTE = "select o_orderkey as id, case when o_orderkey % 97 = 0 then -1 else o_custkey end as user_id, o_totalprice + 1 as amt, 1 + (o_orderkey % 2) as version, (o_orderkey % 13 = 0) as is_deleted, o_orderkey % 40 as modified_at from orders where o_orderkey % 7 <> 0"
_KIND = "CASE WHEN l.id IS NOT NULL AND r.user_id <> l.user_id THEN 'userMismatch' WHEN l.id IS NULL THEN 'none' WHEN l.is_deleted <> r.is_deleted THEN 'deletionConflict' WHEN l.version <> r.version THEN 'bothModified' ELSE 'none' END"
_BOTH = f"SELECT r.*, l.id AS lid, l.version AS lv, l.modified_at AS lm, l.amt AS lamt, {_KIND} AS kind FROM ({_REMOTE}) r LEFT JOIN ({_LOCAL}) l ON r.id = l.id"


def _replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _view(spark, d, _LOCAL), _view(spark, d, _REMOTE)


@_register("s_detect", f"SELECT id, kind, CASE WHEN kind = 'none' THEN CASE WHEN lid IS NULL THEN 'create' ELSE 'update' END WHEN version > lv OR (version = lv AND modified_at > lm) THEN 'takeRemote' ELSE 'takeLocal' END AS action FROM ({_BOTH})")
def _(spark, d):
    local, remote = _replicas(spark, d)
    return reconcile.classify(local, remote, each=True).select("id", "kind", "action")


def _pull_sql(takes: str, amount: str = "amt") -> str:
    columns = f"id, user_id, {amount} AS amt, version, is_deleted"
    return f"WITH b AS ({_BOTH}), w AS (SELECT {columns} FROM b WHERE kind = 'none' OR {takes}) SELECT * FROM w UNION ALL SELECT id, user_id, amt, version, is_deleted FROM ({_LOCAL}) WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM w)"


def _pulled(spark: SparkSession, d: str, resolver, merge=None) -> DataFrame:
    local, remote = _replicas(spark, d)
    return reconcile.pull(reconcile.matched(local, remote, resolver=resolver, each=True), merge).select("id", "user_id", "amt", "version", "is_deleted")


@_register("s_pull_lww", _pull_sql("version > lv OR (version = lv AND modified_at > lm)"))
def _(spark, d):
    return _pulled(spark, d, reconcile.last_write_wins)


@_register("s_pull_local", _pull_sql("FALSE"))
def _(spark, d):
    return _pulled(spark, d, reconcile.local_priority)


@_register("s_pull_remote", _pull_sql("TRUE"))
def _(spark, d):
    return _pulled(spark, d, reconcile.remote_priority)


@_register("s_pull_merge", _pull_sql("TRUE", "CASE WHEN kind = 'none' THEN amt ELSE greatest(amt, lamt) END"))
def _(spark, d):
    return _pulled(spark, d, reconcile.merging, lambda l, r: [r["id"], r["user_id"], F.greatest(l["amt"], r["amt"]), r["version"], r["is_deleted"], r["modified_at"]])


@_register("s_pull_prompt", _pull_sql("id % 3 = 0"))
def _(spark, d):
    choice = F.when(F.col("id") % 3 == 0, reconcile.TAKE_REMOTE).when(F.col("id") % 3 == 1, reconcile.TAKE_LOCAL)
    return _pulled(spark, d, reconcile.decided(choice))


@_register("s_pull_counts", f"SELECT count(*) FILTER (kind <> 'none') AS conflicts_resolved, count(*) FILTER (kind = 'none' OR version > lv OR (version = lv AND modified_at > lm)) AS written FROM ({_BOTH})")
def _(spark, d):
    local, remote = _replicas(spark, d)
    return reconcile.pull_counts(reconcile.classify(local, remote, each=True)).select("conflicts_resolved", "written")


#: Users share ids here: two orders have one id, and their users differ.
_SHARED_LOCAL = _LOCAL.replace("o_orderkey as id, o_custkey as user_id", "o_orderkey div 2 as id, 2 * o_custkey + o_orderkey % 2 as user_id")
_SHARED_REMOTE = _REMOTE.replace("o_orderkey as id", "o_orderkey div 2 as id").replace("case when o_orderkey % 97 = 0 then -1 else o_custkey end", "case when o_orderkey % 97 = 0 then -1 - o_orderkey % 2 else 2 * o_custkey + o_orderkey % 2 end")
_DUCK = lambda sql: sql.replace(" div ", " // ")
_SHARED = f"""WITH l AS ({_DUCK(_SHARED_LOCAL)}), r AS ({_DUCK(_SHARED_REMOTE)}),
holder AS (SELECT id, min(user_id) AS holder FROM l GROUP BY id),
b AS (SELECT r.*, l.id IS NOT NULL AS own, c.id IS NOT NULL AS met, c.version AS lv, c.modified_at AS lm, c.amt AS lamt, c.is_deleted AS ld FROM r LEFT JOIN l ON r.id = l.id AND r.user_id = l.user_id
  LEFT JOIN holder h ON l.id IS NULL AND r.id = h.id LEFT JOIN l c ON c.id = r.id AND c.user_id = CASE WHEN l.id IS NULL THEN h.holder ELSE l.user_id END),
k AS (SELECT *, CASE WHEN NOT own AND met THEN 'userMismatch' WHEN NOT met THEN 'none' WHEN ld <> is_deleted THEN 'deletionConflict' WHEN lv <> version THEN 'bothModified' ELSE 'none' END AS kind FROM b),
a AS (SELECT *, CASE WHEN kind = 'none' THEN CASE WHEN met THEN 'update' ELSE 'create' END WHEN version > lv OR (version = lv AND modified_at > lm) THEN 'takeRemote' ELSE 'takeLocal' END AS action FROM k)
"""


def _shared(spark: SparkSession, d: str, resolver=reconcile.last_write_wins) -> DataFrame:
    return reconcile.matched(_view(spark, d, _SHARED_LOCAL), _view(spark, d, _SHARED_REMOTE), resolver=resolver, each=True)


@_register("s_detect_shared", _SHARED + "SELECT user_id, id, kind, action FROM a")
def _(spark, d):
    return _shared(spark, d).where("r is not null").select("r.user_id", "id", "kind", "action")


@_register("s_pull_shared", _SHARED + ", w AS (SELECT * FROM a WHERE action <> 'takeLocal') SELECT id, user_id, amt, version, is_deleted FROM w UNION ALL SELECT id, user_id, amt, version, is_deleted FROM l WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM w)")
def _(spark, d):
    return reconcile.pull(_shared(spark, d)).select("id", "user_id", "amt", "version", "is_deleted")


@_register("s_pull_shared_merge", _SHARED + ", w AS (SELECT id, user_id, CASE WHEN kind = 'none' THEN amt ELSE greatest(amt, lamt) END AS amt, version FROM a) SELECT id, user_id, amt, version FROM w UNION ALL SELECT id, user_id, amt, version FROM l WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM w)")
def _(spark, d):
    found = _shared(spark, d, reconcile.merging)
    return reconcile.pull(found, lambda l, r: [r["id"], l["user_id"], F.greatest(l["amt"], r["amt"]), r["version"], r["is_deleted"], r["modified_at"]]).select("id", "user_id", "amt", "version")


@_register(
    "s_pull_observed",
    _SHARED + "SELECT 'all' AS user_id, count(*) FILTER (action <> 'takeLocal') AS synced, count(*) FILTER (kind <> 'none') AS conflicts_resolved, CAST(coalesce(sum(len('{\"id\":' || id || ',\"user_id\":' || user_id || ',\"version\":' || version || '}')) FILTER (kind = 'none'), 0) AS BIGINT) AS bytes_pulled FROM a",
)
def _(spark, d):
    """A pull's figures, observed while the table is written, as the results table has them."""
    columns = ["id", "user_id", "version", "is_deleted", "modified_at"]
    found = reconcile.matched(_view(spark, d, _SHARED_LOCAL).select(columns), _view(spark, d, _SHARED_REMOTE).select(columns), each=True)
    path = scratch.fresh(spark, "results")
    counts = reconcile.observed_pull(found, lambda df: df.write.parquet(scratch.fresh(spark, "pulled")), sized=("id", "user_id", "version"))
    results.append(spark, path, {"user_id": "all", "synced": counts["written"], "conflicts_resolved": counts["conflicts_resolved"], "bytes_pulled": counts["bytes_pulled"]}, 1)
    return results.last(spark, path).select("user_id", "synced", "conflicts_resolved", "bytes_pulled")


_CHOICE = "CASE WHEN id % 4 = 0 THEN 'takeRemote' WHEN id % 4 = 1 THEN 'takeLocal' WHEN id % 4 = 2 THEN 'merge' END"


@_register("s_resolutions", f"SELECT id, user_id, kind, coalesce(choice, 'askUser') AS strategy, CASE choice WHEN 'takeRemote' THEN amt WHEN 'takeLocal' THEN lamt WHEN 'merge' THEN greatest(amt, lamt) END AS amt, choice IS NULL AS asks, CASE WHEN choice IS NULL THEN kind || ' of ' || id || ' needs a choice' END AS message FROM (SELECT *, {_CHOICE} AS choice FROM ({_BOTH})) WHERE kind <> 'none'")
def _(spark, d):
    """Each conflict with what its resolution is, ends with, and waits for."""
    local, remote = _replicas(spark, d)
    found = reconcile.classify(local, remote, resolver=reconcile.decided(F.expr(_CHOICE)), each=True)
    merge = lambda l, r: [r["id"], r["user_id"], F.greatest(l["amt"], r["amt"]), r["version"], r["is_deleted"], r["modified_at"]]
    x = "resolution."
    return reconcile.resolutions(found, merge).select("id", "user_id", "kind", x + "strategy", x + "data.amt", F.col(x + "requires_user_input").alias("asks"), x + "message")


_PUSHED = "select o_orderkey div 2 as id, 2 * o_custkey + o_orderkey % 2 as user_id, o_totalprice + 2 as amt, 9 as version, false as is_deleted, 100 as modified_at from orders where o_orderkey % 5 = 0"
_GONE = "select o_orderkey div 2 as id, 2 * o_custkey + o_orderkey % 2 as user_id from orders where o_orderkey % 6 = 0"
_AFTER_PUSH = f"""WITH l0 AS ({_DUCK(_SHARED_LOCAL)}), r0 AS ({_DUCK(_SHARED_REMOTE)}), p AS ({_DUCK(_PUSHED)}),
l AS (SELECT * FROM p UNION ALL SELECT * FROM l0 WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM p)),
r AS (SELECT p.* REPLACE (CASE WHEN r0.id IS NOT NULL AND l0.is_deleted = p.is_deleted THEN r0.is_deleted ELSE p.is_deleted END AS is_deleted) FROM p LEFT JOIN l0 ON p.id = l0.id AND p.user_id = l0.user_id LEFT JOIN r0 ON p.id = r0.id AND p.user_id = r0.user_id
  UNION ALL SELECT * FROM r0 WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM p)),
"""
_AFTER_DELETE = f"""WITH l0 AS ({_DUCK(_SHARED_LOCAL)}), r0 AS ({_DUCK(_SHARED_REMOTE)}), p AS ({_DUCK(_GONE)}),
l AS (SELECT * FROM l0 WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM p)),
r AS (SELECT * FROM r0 WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM p JOIN l0 USING (user_id, id))),
"""


def _synced_sql(after: str) -> str:
    """Both replicas after the pull that follows a write."""
    rows = "id, user_id, amt, version, is_deleted"
    pulled = after + _SHARED[_SHARED.index("holder AS") :] + ", w AS (SELECT * FROM a WHERE action <> 'takeLocal')"
    return f"{pulled} SELECT 'remote' AS replica, {rows} FROM r UNION ALL SELECT 'local', {rows} FROM w UNION ALL SELECT 'local', {rows} FROM l WHERE (user_id, id) NOT IN (SELECT (user_id, id) FROM w)"


def _both_replicas(done: writesync.Synced) -> DataFrame:
    one = lambda df, name: df.select(F.lit(name).alias("replica"), "id", "user_id", "amt", "version", "is_deleted")
    return one(done.local, "local").unionByName(one(done.remote, "remote"))


@_register("s_push_sync", _synced_sql(_AFTER_PUSH))
def _(spark, d):
    """Rows saved and synchronised at once, of users that share ids."""
    local, remote = _view(spark, d, _SHARED_LOCAL), _view(spark, d, _SHARED_REMOTE)
    return _both_replicas(writesync.push_and_sync(local, remote, _view(spark, d, _PUSHED), F.col("id"), F.lit(0)))


@_register("s_delete_sync", _synced_sql(_AFTER_DELETE))
def _(spark, d):
    """Deletes synchronised at once: what was local goes on both sides, what only the remote side has stays there and is pulled."""
    local, remote = _view(spark, d, _SHARED_LOCAL), _view(spark, d, _SHARED_REMOTE)
    return _both_replicas(writesync.delete_and_sync(local, remote, _view(spark, d, _GONE), F.col("id"), F.lit(0)))


@_register("s_diff", f"SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'create' WHEN r.id IS NULL THEN 'delete' WHEN l.user_id <> r.user_id OR l.version <> r.version OR l.is_deleted <> r.is_deleted THEN 'update' ELSE 'same' END AS change, CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL AND l.version <> r.version THEN CAST(r.version AS VARCHAR) END AS new_version FROM ({_LOCAL}) l FULL JOIN ({_REMOTE}) r ON l.id = r.id")
def _(spark, d):
    local, remote = _replicas(spark, d)
    found = changes.diff(local, remote, ["id"], ["user_id", "version", "is_deleted"])
    return found.select("id", "change", F.try_element_at("delta", F.lit("version")).alias("new_version"))


_SLOTS = "SELECT user_id * 10 + event_id % 10 AS id, event_id AS seq, event_id % 5 AS kind, event_id % 97 AS a, event_id % 89 AS b, CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS sets FROM events"
_REPLAY = f"""WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n, kind IN (1, 2, 4) AND sets > 0 AS is_delta FROM ({_SLOTS})),
base AS (SELECT c_custkey AS id, -1::BIGINT AS a, -2::BIGINT AS b FROM customer WHERE c_custkey % 3 = 0),
keys AS (SELECT id FROM base UNION SELECT id FROM ops),
fold AS (
  SELECT k.id, 0::BIGINT AS n, base.id IS NOT NULL AS there, base.a, base.b FROM keys k LEFT JOIN base ON k.id = base.id
  UNION ALL
  SELECT f.id, o.n, o.kind <> 3,
    CASE WHEN o.kind = 3 THEN NULL WHEN f.there AND o.is_delta AND o.sets <> 1 THEN f.a ELSE o.a END,
    CASE WHEN o.kind = 3 THEN NULL WHEN f.there AND o.is_delta AND o.sets <> 2 THEN f.b ELSE o.b END
  FROM fold f JOIN ops o ON f.id = o.id AND o.n = f.n + 1)
SELECT id, a, b FROM (SELECT *, max(n) OVER (PARTITION BY id) AS last FROM fold) WHERE there AND n = last"""


@_register("s_push_replay", _REPLAY)
def _(spark, d):
    e = _t(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("create", "update", "patch", "delete", "patch"))), (F.col("event_id") % 5 + 1).cast("int"))
    ops = e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("id"), F.col("event_id").alias("seq"), kind.alias("type"), F.struct((F.col("event_id") % 97).alias("a"), (F.col("event_id") % 89).alias("b")).alias("full"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), (F.col("event_id") % 97).cast("string"))).when(F.col("event_id") % 3 == 0, F.create_map(F.lit("b"), (F.col("event_id") % 89).cast("string"))).alias("delta"))
    base = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("a"), F.lit(-2).cast("long").alias("b"))
    return changes.replay(base, ops, ["a", "b"])


@_register("s_retry_outcomes", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'synced' WHEN event_id % 3 > 0 AND event_id % 5 < 3 THEN 'retry' ELSE 'dead' END AS outcome, CAST(event_id % 5 + CASE WHEN event_id % 4 <> 0 AND event_id % 3 > 0 AND event_id % 5 < 3 THEN 1 ELSE 0 END AS BIGINT) AS retry_count FROM events")
def _(spark, d):
    n = F.col("event_id")
    tries = _t(spark, d, "events").select(n, F.when(n % 4 != 0, "timeout").alias("error"), (n % 3 > 0).alias("retryable"), (n % 5).alias("retry_count"))
    return changes.outcomes(tries).select("event_id", "outcome", F.col("retry_count").cast("long").alias("retry_count"))


@_register("s_retry_delays", "SELECT event_id, CASE WHEN event_type = 'view' OR event_id % 5 >= 4 THEN 'dead' ELSE 'retry' END AS outcome, CASE WHEN event_type <> 'view' AND event_id % 5 < 4 THEN (event_id % 5 + 1) * (event_id % 5 + 1) * 250 END AS delay_ms FROM events")
def _(spark, d):
    """Retries by a test and a backoff of the caller's own."""
    tries = _t(spark, d, "events").select("event_id", F.col("event_type").alias("error"), (F.col("event_id") % 5).alias("retry_count"))
    done = changes.outcomes(tries, 4, F.col("error") != "view", lambda n: n * n * 250)
    return done.select("event_id", "outcome", "delay_ms")


@_register("s_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE o_totalprice END AS amt FROM orders")
def _(spark, d):
    base = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amt"))
    return changes.upsert(base, base.where("id % 3 = 0").withColumn("amt", F.lit(1.0)), ["id"])


@_register("s_patch", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders")
def _(spark, d):
    base = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    deltas = base.where("id % 3 = 0").select("id", F.create_map(F.lit("status"), F.lit(None).cast("string")).alias("delta"))
    return changes.patch(base, deltas, ["id"], ["status", "cust"])


@_register("s_delete", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    base = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return changes.delete(base, base.where("id % 3 = 0"), ["id"])


@_register("s_metadata", "SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    meta = integrity.metadata({"orders": _t(spark, d, "orders").withColumnRenamed("o_custkey", "user_id")}, F.lit(0))
    return meta.select("user_id", F.element_at("entity_counts", F.lit("orders")).alias("n"))


@_register("s_hash", "SELECT c_mktsegment, count(*) AS n, sha256('[' || string_agg('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}', ',' ORDER BY c_custkey) || ']') AS hash FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return integrity.content_hash(_t(spark, d, "customer"), ["c_custkey", "c_name"], "c_custkey", ["c_mktsegment"])


_TREE_ROWS = "select o_orderkey, o_custkey as user_id, o_orderstatus, o_orderpriority from orders"
_TREE_OTHER = "select o_orderkey, o_custkey as user_id, case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_orderkey % 101 <> 0 union all select -o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 211 = 0"
_TREE_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def _tree_sql(rows: str, by: str, digits: int) -> str:
    """The root of each group, by nested hashes."""
    json = "'{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}'"
    level = f"SELECT {by}, substr(sha256(o_orderkey::VARCHAR), 1, {digits}) AS p, count(*) AS n, sha256(string_agg(sha256({json}), '' ORDER BY o_orderkey)) AS h FROM ({rows}) GROUP BY ALL"
    for k in range(digits - 1, -1, -1):
        level = f"SELECT {by}, substr(p, 1, {k}) AS p, sum(n) AS n, sha256(string_agg(q || ':' || h, ',' ORDER BY q)) AS h FROM (SELECT {by}, p AS q, p, n, h FROM ({level})) GROUP BY {by}, substr(p, 1, {k})"
    return f"SELECT {by}, n::BIGINT AS n, h AS hash FROM ({level})"


@_register("s_hash_tree", _tree_sql(_TREE_ROWS, "user_id", 2))
def _(spark, d):
    return hashtree.roots(_view(spark, d, _TREE_ROWS), _TREE_COLUMNS, "o_orderkey", ["user_id"], 2)


@_register("s_hash_tree_hot", _tree_sql(_TREE_ROWS, "o_orderstatus", 3))
def _(spark, d):
    """Three groups that hold the whole table: each is spread over 4,096 leaves."""
    return hashtree.roots(_view(spark, d, _TREE_ROWS), _TREE_COLUMNS, "o_orderkey", ["o_orderstatus"], 3)


@_register(
    "s_hash_drift",
    f"""WITH a AS ({_TREE_ROWS}), b AS ({_TREE_OTHER}), x AS (SELECT coalesce(a.user_id, b.user_id) AS u, substr(sha256(coalesce(a.o_orderkey, b.o_orderkey)::VARCHAR), 1, 2) AS p
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority)
SELECT 'local' AS side, user_id, o_orderkey FROM a WHERE (user_id, substr(sha256(o_orderkey::VARCHAR), 1, 2)) IN (SELECT (u, p) FROM x)
UNION ALL SELECT 'remote', user_id, o_orderkey FROM b WHERE (user_id, substr(sha256(o_orderkey::VARCHAR), 1, 2)) IN (SELECT (u, p) FROM x)""",
)
def _(spark, d):
    sides = {"local": _view(spark, d, _TREE_ROWS), "remote": _view(spark, d, _TREE_OTHER)}
    trees = [hashtree.tree(df, _TREE_COLUMNS, "o_orderkey", ["user_id"], 2) for df in sides.values()]
    ranges = scratch.written(hashtree.differing(*trees, ["user_id"], 2), "ranges")
    parts = [hashtree.rows_in(df, ranges, "o_orderkey", ["user_id"], 2).select(F.lit(name).alias("side"), "user_id", "o_orderkey") for name, df in sides.items()]
    return parts[0].unionByName(parts[1])


@_register(
    "s_metadata_hashed",
    f"WITH o AS ({_tree_sql(_TREE_ROWS, 'user_id', 2)}), p AS ({_tree_sql(_TREE_ROWS + ' where o_orderkey % 2 = 0', 'user_id', 2)}) SELECT o.user_id, o.n AS orders, o.hash AS orders_hash, p.n AS even, sha256(CASE WHEN p.hash IS NULL THEN '' ELSE 'even:' || p.hash || ',' END || 'orders:' || o.hash) AS data_hash FROM o LEFT JOIN p ON o.user_id = p.user_id",
)
def _(spark, d):
    """Metadata with tree hashes, saved to both replicas and read back from the second."""
    rows = _view(spark, d, _TREE_ROWS)
    meta = integrity.hashed_metadata({"orders": (rows, _TREE_COLUMNS, "o_orderkey"), "even": (rows.where("o_orderkey % 2 = 0"), _TREE_COLUMNS, "o_orderkey")}, F.lit(1))
    replicas = [scratch.fresh(spark, f"{side}-metadata") for side in ("local", "remote")]
    integrity.save_metadata(meta, *replicas)
    e = lambda name: F.try_element_at("entity_counts", F.lit(name))
    return integrity.saved_metadata(spark, replicas[1]).select("user_id", e("orders")["n"].alias("orders"), e("orders")["hash"].alias("orders_hash"), e("even")["n"].alias("even"), "data_hash")


@_register("m_migrate_chain", "SELECT p_partkey, p_name AS title, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS priority FROM part")
def _(spark, d):
    steps = [
        migrate.Migration(1, 2, lambda df: df.select("p_partkey", F.col("p_name").alias("title"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("p_size") % 3 + 1).alias("priority"))),
        migrate.Migration(2, 3, lambda df: df.withColumn("priority", F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3))),
    ]
    return migrate.migrate(_t(spark, d, "part"), steps, 1, 3)


@_register(
    "m_raw_scan",
    "SELECT 1 AS schema_version, p_partkey, NULL AS title, CASE WHEN p_size % 3 = 0 THEN p_size END::INTEGER AS priority, p_name AS old_name, CASE WHEN p_size % 3 <> 0 THEN 'size ' || p_size END AS old_priority FROM part WHERE p_partkey % 2 = 0 "
    "UNION ALL SELECT 2, p_partkey, p_name, p_size, NULL, NULL FROM part WHERE p_partkey % 2 = 1",
)
def _(spark, d):
    """Two schema versions: the older one's name has no column any more, and some of its priorities are no numbers."""
    part = _t(spark, d, "part")
    old = part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("priority"))
    new = part.where("p_partkey % 2 = 1").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("priority"))
    rest = lambda c: F.try_element_at("rest", F.lit(c))
    return rawscan.raw_scan({1: old, 2: new}).select("schema_version", "p_partkey", "title", "priority", rest("name").alias("old_name"), rest("priority").alias("old_priority"))


@_register("q_adapter_scope", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 AND o_orderkey % 3 = 0")
def _(spark, d):
    """A scoped remote read by way of the data source: two filters are the adapter's, one is Spark's."""
    adapter.register(spark)
    with adapter.pushdown(spark):
        orders = spark.read.format(adapter.FORMAT).option("path", f"{d}/orders.parquet").option("target", "remote").load()
        found = entity.scoped(orders, _q().where("o_orderstatus", eq="O").where("o_totalprice", gt=200000.0).build()).where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice")
        return scratch.written(found, "scope")


@_register("m_target_projection", "SELECT p_partkey, p_name, p_brand FROM part")
def _(spark, d):
    part = entity.Entity("part", local_only=("p_size", "p_type", "p_retailprice"))
    return entity.project(_t(spark, d, "part"), part, "remote")


@_register("m_camel_columns", 'SELECT c_custkey AS "cCustkey", c_name AS "cName" FROM customer')
def _(spark, d):
    return scalars.camel_columns(_t(spark, d, "customer").select("c_custkey", "c_name"))


_DEDUP = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
taken AS (
  SELECT user_id, event_id, t, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, t, n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS place FROM taken k JOIN e ON e.user_id = k.user_id AND e.n > k.n AND e.t - k.t > 3600000000) WHERE place = 1)
SELECT user_id, event_id FROM taken"""


@_register("t_dedup_ttl", _DEDUP)
def _(spark, d):
    return live.suppress(_t(spark, d, "events"), "user_id", "ts", ["event_id"], 3600.0)


@_register("t_live_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return live.live_count(_t(spark, d, "events"), "event_type")


@_register("t_latest_by_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    return live.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@_register("t_change_apply", "WITH c AS (SELECT user_id AS id, event_id AS v, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT id, v FROM c WHERE event_type <> 'view' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT id FROM c)")
def _(spark, d):
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("v"))
    kind = F.when(F.col("event_type") == "view", "delete").otherwise("update")
    log = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("v"), kind.alias("type"), "ts")
    return live.apply_changes(base, log, "id", ["ts", "v"])


@_register("s_push", f"SELECT id, amt FROM (SELECT id, amt FROM ({_REMOTE}) UNION ALL SELECT id, amt FROM ({_LOCAL}) WHERE id NOT IN (SELECT id FROM ({_REMOTE})))")
def _(spark, d):
    local, remote = _replicas(spark, d)
    saved, _ = changes.push(local, remote, ["id"], ["user_id", "amt"], F.col("id") * 0, F.col("id"), F.lit(0))
    return saved.select("id", "amt")


@_register("s_push_log", f"SELECT r.id, CASE WHEN l.id IS NULL THEN 'create' ELSE 'update' END AS type, r.version AS version FROM ({_REMOTE}) r LEFT JOIN ({_LOCAL}) l ON r.id = l.id WHERE l.id IS NULL OR l.user_id <> r.user_id OR l.version <> r.version")
def _(spark, d):
    local, remote = _replicas(spark, d)
    _, log = changes.push(local, remote, ["id"], ["user_id", "version"], F.col("id") * 0, F.col("id"), F.lit(0))
    return log.select("id", "type", F.col("full.version").alias("version"))


@_register("s_deleted", "SELECT l_orderkey AS id, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AS went FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    base = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return changes.deleted(base, _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")), ["id"])


@_register("q_keyset_two", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderkey > 500) ORDER BY o_orderstatus DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return paging.after(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus", "o_orderkey"], ("O", 500), descending=[True])


_EXTERNAL = "select event_id, user_id, case when event_type = 'view' then 'delete' else 'update' end as type, case when event_id % 3 = 0 then 'local' else 'remote' end as source_id from events"


@_register("t_external_apply", f"SELECT event_id, type FROM ({_EXTERNAL}) WHERE source_id = 'local' AND type <> 'delete'")
def _(spark, d):
    return live.queued(live.applied(_view(spark, d, _EXTERNAL))).select("event_id", "type")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; a pattern stands for a file as well as for a folder."""
    return spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@_register("t_stream_suppress", _DEDUP)
def _(spark, d):
    """The stream that t_dedup_ttl is the batch twin of, run to its end."""
    events = _event_stream(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = scratch.fresh(spark, "kept")
    with deltas.rocksdb(spark):
        kept = live.suppress_stream(events, "user_id", "ts", 3600.0, ["event_id"]).select("user_id", "event_id")
        kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.fresh(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_id long").parquet(out)


@_register("t_stream_counts", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'view' GROUP BY event_type")
def _(spark, d):
    """Users by their last event, views out: a count kept by signed changes."""
    kind = F.when(F.col("event_type") == "view", "delete").otherwise("update")
    changes_ = _event_stream(spark, d).select("user_id", "event_type", F.col("event_id").alias("seq"), kind.alias("type"))
    path = scratch.fresh(spark, "counts")
    with deltas.rocksdb(spark):
        rows = deltas.signed(changes_, "user_id", ["user_id", "event_type"], "seq")
        deltas.live_counts(rows, path, scratch.fresh(spark, "checkpoint"), ["event_type"]).awaitTermination()
    return Version(spark, f"{path}/counts", spark.createDataFrame([], "event_type string, n long").schema).read()


@_register(
    "t_stream_external",
    f"SELECT user_id AS id, event_id AS v, CASE WHEN before IS NULL AND user_id NOT IN (SELECT c_custkey FROM customer) OR before = 'delete' THEN 'create' ELSE 'update' END AS type FROM (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ({_EXTERNAL})) WHERE source_id = 'local' AND type <> 'delete'",
)
def _(spark, d):
    """What outside changes queue for the remote side."""
    kind, source = F.when(F.col("event_type") == "view", "delete").otherwise("update"), F.when(F.col("event_id") % 3 == 0, "local").otherwise("remote")
    stream = _event_stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("v"), kind.alias("type"), source.alias("source_id"), F.col("event_id").alias("ts"))
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("v"))
    table = external.ExternalChanges(scratch.fresh(spark, "external"), base, "id", ["id", "v"])
    table.start(stream, scratch.fresh(spark, "checkpoint")).awaitTermination()
    return table.queue().select("id", F.col("full.v").alias("v"), "type")


@_register("t_watch_related", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    query = live.by_relation(lambda: _t(spark, d, "customer").where("c_acctbal < 0"), HasMany("o_custkey", "c_custkey"))
    return query(_t(spark, d, "orders")).select("o_orderkey", "o_totalprice")


@_register("m_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 AS back FROM events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return _t(spark, d, "events").select("event_id", scalars.iso_text(ts).alias("iso"), scalars.epoch_ms(ts).alias("ms"), scalars.epoch_ms(scalars.from_iso(scalars.iso_text(ts))).alias("back"))


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
