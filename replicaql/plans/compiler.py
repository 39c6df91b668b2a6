"""Query -> Column and DataFrame. A null field fails every test but those for null; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedFilter
from ..functions import geo
from .model import Composite, Condition, Filter, Logic, Op, Query, Sort, Within

Hook = Callable[[Filter], Column | None]

_COMPARE: dict[Op, Callable[[Column, object], Column]] = {
    Op.GT: lambda c, v: c > v,
    Op.GE: lambda c, v: c >= v,
    Op.LT: lambda c, v: c < v,
    Op.LE: lambda c, v: c <= v,
    Op.CONTAINS: lambda c, v: c.contains(v),
    Op.CONTAINS_CI: lambda c, v: F.lower(c).contains(str(v).lower()),
    Op.STARTS: lambda c, v: c.startswith(v),
    Op.ENDS: lambda c, v: c.endswith(v),
    Op.MATCHES: lambda c, v: c.rlike(v),
    Op.ARRAY_CONTAINS: lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)),
}


def _items(value: object) -> list | None:
    return [x for x in value if x is not None] if isinstance(value, list | tuple | set | frozenset) else None


def _filter(f: Filter) -> Column:
    c, v, never = F.col(f.field), f.value, F.lit(False)
    match f.op:
        case Op.NULL:
            return c.isNull()
        case Op.NOT_NULL:
            return c.isNotNull()
        case Op.EQ:
            return never if v is None else c == v
        case Op.NE:
            return c.isNotNull() if v is None else c != v
        case Op.IN:
            found = _items(v)
            return c.isin(found) if found else never
        case Op.NOT_IN:
            found = _items(v)
            return c.isNotNull() & ~c.isin(found) if found else c.isNotNull()
        case Op.BETWEEN:
            found = _items(v)
            return c.between(*found) if found and len(found) == 2 else never
        case Op.ARRAY_ANY:
            found = _items(v)
            return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, found))), never) if found else never
        case Op.WITHIN if isinstance(v, Within):
            lat, lon = F.col(f"{f.field}.latitude").cast("double"), F.col(f"{f.field}.longitude").cast("double")
            near = geo.haversine(lat, lon, v.latitude, v.longitude) <= v.radius
            return F.coalesce(geo.box(lat, lon, v.latitude, v.longitude, v.radius) & near, never)
        case op if op in _COMPARE:
            return never if v is None else _COMPARE[op](c, v)
    raise UnsupportedFilter(f"{f}")


def predicate(condition: Condition, custom: Hook | None = None) -> Column:
    """The Column of a condition; custom may answer for a filter first."""
    if isinstance(condition, Composite):
        return _combined(condition.logic, condition.conditions, custom, empty=condition.logic is Logic.AND)
    if isinstance(condition, Filter):
        own = custom(condition) if custom else None
        return _filter(condition) if own is None else own
    raise UnsupportedFilter(f"{type(condition).__name__}")


def _combined(logic: Logic, conditions: Sequence[Condition], custom: Hook | None, empty: bool) -> Column:
    found = [predicate(c, custom) for c in conditions]
    return reduce(and_ if logic is Logic.AND else or_, found) if found else F.lit(empty)


def ordering(s: Sort) -> Column:
    c = F.col(s.field)
    if s.descending:
        return c.desc_nulls_first() if s.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if s.nulls_first else c.asc_nulls_last()


def apply(df: DataFrame, query: Query, key: Sequence[str] = (), custom: Hook | None = None) -> DataFrame:
    """Filter, sort, offset, limit. key: unique columns that settle ties. No filters at all keep every row."""
    if query.filters:
        df = df.where(_combined(query.logic, query.filters, custom, empty=True))
    order = [ordering(s) for s in query.sorting] + [F.col(k) for k in key if k not in {s.field for s in query.sorting}]
    if query.sorting or ((query.limit or query.offset) and order):
        df = df.orderBy(*order)
    if query.offset:
        df = df.offset(query.offset)
    return df if query.limit is None else df.limit(query.limit)


def count(df: DataFrame, query: Query | None = None) -> DataFrame:
    return (apply(df, query) if query else df).agg(F.count("*").alias("n"))


def first(df: DataFrame, query: Query, key: Sequence[str] = ()) -> DataFrame:
    return apply(df, query.replace(limit=1), key)

