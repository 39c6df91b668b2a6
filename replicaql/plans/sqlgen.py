"""Query -> SQL text with parameters (SQLite, PostgreSQL, custom placeholders), and text with literals (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from ..errors import UnsupportedFilter
from .model import Composite, Condition, Filter, Op, Query

DIALECTS = ("sqlite", "postgresql", "custom")
Custom = Callable[[Filter, Callable[[], str], list], "str | None"]

#: SQL operators.
SYMBOLS = {Op.EQ: "=", Op.NE: "!=", Op.GT: ">", Op.GE: ">=", Op.LT: "<", Op.LE: "<=", Op.CONTAINS: "LIKE", Op.STARTS: "LIKE", Op.ENDS: "LIKE"}
#: Where a pattern's wildcards go.
PATTERNS = {Op.CONTAINS: "%{}%", Op.CONTAINS_CI: "%{}%", Op.STARTS: "{}%", Op.ENDS: "%{}"}


def quoted(name: str) -> str:
    """An identifier; quotes in a name are doubled."""
    return '"' + name.replace('"', '""') + '"'


class _Writer:
    def __init__(self, dialect: str, custom: Custom | None, placeholder: Callable[[int], str] | None):
        self.dialect, self.custom, self.params, self.used = dialect, custom, [], 0
        self.shape = placeholder or ((lambda i: f"${i}") if dialect == "postgresql" else lambda _: "?")

    def mark(self) -> str:
        self.used += 1
        return self.shape(self.used)

    def bind(self, *values: object) -> list[str]:
        self.params += values
        return [self.mark() for _ in values]

    def symbol(self, op: Op) -> str:
        if op is Op.CONTAINS_CI:
            return "ILIKE" if self.dialect == "postgresql" else "LIKE"
        found = {"sqlite": "REGEXP", "postgresql": "~"}.get(self.dialect) if op is Op.MATCHES else SYMBOLS.get(op)
        if found is None:
            raise UnsupportedFilter(f"{op.value} has no general SQL for {self.dialect}; give a custom builder")
        return found

    def condition(self, c: Condition) -> str:
        if isinstance(c, Composite):
            return "(" + f" {c.logic.value} ".join(map(self.condition, c.conditions)) + ")"
        if not isinstance(c, Filter):
            raise UnsupportedFilter(type(c).__name__)
        own = self.custom(c, self.mark, self.params) if self.custom else None
        return own if own is not None else self.filter(c)

    def filter(self, f: Filter) -> str:
        name = quoted(f.field)
        if f.op in (Op.NULL, Op.NOT_NULL):
            return f"{name} IS {'NOT ' * (f.op is Op.NOT_NULL)}NULL"
        if f.op in (Op.IN, Op.NOT_IN):
            if not isinstance(f.value, list | tuple) or not f.value:
                return "0=1" if f.op is Op.IN else "1=1"
            return f"{name} {'NOT ' * (f.op is Op.NOT_IN)}IN ({', '.join(self.bind(*f.value))})"
        if f.op is Op.BETWEEN:
            return f"{name} BETWEEN {' AND '.join(self.bind(*f.value))}"
        symbol = self.symbol(f.op)
        value = PATTERNS[f.op].format(f.value) if f.op in PATTERNS else f.value
        if f.op is Op.CONTAINS_CI and self.dialect == "sqlite":
            name, value = f"LOWER({name})", value.lower()
        return f"{name} {symbol} {self.bind(value)[0]}"


def to_sql(query: Query, table: str, dialect: str = "sqlite", custom: Custom | None = None, placeholder: Callable[[int], str] | None = None) -> tuple[str, list]:
    if dialect not in DIALECTS:
        raise ValueError(f"dialects are {DIALECTS}")
    if dialect == "custom" and placeholder is None:
        raise ValueError("a custom dialect needs a placeholder function")
    w = _Writer(dialect, custom, placeholder)
    parts = [f"SELECT * FROM {quoted(table)}"]
    if query.filters:
        parts.append("WHERE " + f" {query.logic.value} ".join(map(w.condition, query.filters)))
    if query.sorting:
        parts.append("ORDER BY " + ", ".join(f'{quoted(s.field)} {"DESC" if s.descending else "ASC"} NULLS {"FIRST" if s.nulls_first else "LAST"}' for s in query.sorting))
    parts += [f"LIMIT {query.limit}"] * (query.limit is not None) + [f"OFFSET {query.offset}"] * (query.offset is not None)
    return " ".join(parts), w.params


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, datetime | date):
        return f"TIMESTAMP '{v.isoformat(sep=' ') if isinstance(v, datetime) else v.isoformat()}'"
    return repr(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def duckdb_where(c: Condition) -> str:
    """A condition as DuckDB text with the engine's null rules, for oracles."""
    if isinstance(c, Composite):
        return "(" + (f" {c.logic.value} ".join(map(duckdb_where, c.conditions)) or str(c.logic.value == "AND").upper()) + ")"
    assert isinstance(c, Filter)
    n, v = c.field, c.value
    items = ", ".join(literal(x) for x in v if x is not None) if isinstance(v, list | tuple) else ""
    texts = {Op.CONTAINS: "contains({}, {})", Op.STARTS: "starts_with({}, {})", Op.ENDS: "ends_with({}, {})", Op.MATCHES: "regexp_matches({}, {})", Op.ARRAY_CONTAINS: "list_contains({}, {})"}
    match c.op:
        case Op.NULL | Op.NOT_NULL:
            return f"{n} IS {'NOT ' * (c.op is Op.NOT_NULL)}NULL"
        case Op.IN:
            return f"{n} IN ({items})" if items else "FALSE"
        case Op.NOT_IN:
            return f"({n} IS NOT NULL AND {n} NOT IN ({items}))" if items else f"{n} IS NOT NULL"
        case Op.BETWEEN:
            return f"{n} BETWEEN {literal(v[0])} AND {literal(v[1])}"
        case Op.CONTAINS_CI:
            return f"contains(lower({n}), {literal(v.lower())})"
        case Op.ARRAY_ANY:
            return f"list_has_any({n}, [{items}])" if items else "FALSE"
        case Op.EQ if v is None:
            return "FALSE"
        case Op.NE if v is None:
            return f"{n} IS NOT NULL"
        case op if op in texts:
            return texts[op].format(n, literal(v))
        case op if op in SYMBOLS:
            return f"{n} {SYMBOLS[op]} {literal(v)}"
    raise UnsupportedFilter(f"{c}")


def duckdb_sql(query: Query, table: str, columns: str = "*", key: tuple[str, ...] = ()) -> str:
    """The query as DuckDB text over a table or subquery."""
    parts = [f"SELECT {columns} FROM {table}"]
    if query.filters:
        parts.append("WHERE " + f" {query.logic.value} ".join(f"({duckdb_where(c)})" for c in query.filters))
    order = [f"{s.field} {'DESC' if s.descending else 'ASC'} NULLS {'FIRST' if s.nulls_first else 'LAST'}" for s in query.sorting] + list(key)
    if order and (query.sorting or query.limit or query.offset):
        parts.append("ORDER BY " + ", ".join(order))
    parts += [f"LIMIT {query.limit}"] * (query.limit is not None) + [f"OFFSET {query.offset}"] * bool(query.offset)
    return " ".join(parts)
