"""The declarative query model: a filter tree, orderings with null placement, offset and limit. Pure Python."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Op(Enum):
    EQ = "equals"
    NE = "not_equals"
    GT = "greater_than"
    GE = "greater_than_or_equal"
    LT = "less_than"
    LE = "less_than_or_equal"
    CONTAINS = "contains"
    CONTAINS_CI = "contains_ignore_case"
    STARTS = "starts_with"
    ENDS = "ends_with"
    IN = "is_in"
    NOT_IN = "is_not_in"
    NULL = "is_null"
    NOT_NULL = "is_not_null"
    ARRAY_CONTAINS = "array_contains"
    ARRAY_ANY = "array_contains_any"
    MATCHES = "matches"
    WITHIN = "within_distance"
    BETWEEN = "between"


class Logic(Enum):
    AND = "AND"
    OR = "OR"


class Condition:
    """A node of the filter tree."""


@dataclass(frozen=True)
class Filter(Condition):
    field: str
    op: Op
    value: Any = None


@dataclass(frozen=True)
class Composite(Condition):
    logic: Logic
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Within:
    """A circle: centre in degrees, radius in metres."""

    latitude: float
    longitude: float
    radius: float


@dataclass(frozen=True)
class Query:
    filters: tuple[Condition, ...] = ()
    sorting: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int | None = None
    logic: Logic = Logic.AND

    def replace(self, **changes: Any) -> Query:
        """A copy with changes; None keeps a value."""
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})


#: Keyword of where() for each operator that takes a value.
KEYWORDS = {"eq": Op.EQ, "ne": Op.NE, "gt": Op.GT, "ge": Op.GE, "lt": Op.LT, "le": Op.LE, "contains": Op.CONTAINS, "contains_ci": Op.CONTAINS_CI, "starts": Op.STARTS, "ends": Op.ENDS, "is_in": Op.IN, "not_in": Op.NOT_IN, "array_contains": Op.ARRAY_CONTAINS, "array_any": Op.ARRAY_ANY, "matches": Op.MATCHES, "between": Op.BETWEEN}


@dataclass
class QueryBuilder:
    """Collects a Query. Arguments that are None add no filter."""

    logic: Logic = Logic.AND
    _filters: list[Condition] = field(default_factory=list)
    _sorting: list[Sort] = field(default_factory=list)
    _limit: int | None = None
    _offset: int | None = None

    def where(self, name: str, **tests: Any) -> QueryBuilder:
        for key, value in tests.items():
            if key not in KEYWORDS:
                raise TypeError(f"where() has no test {key}")
            if value is None:
                continue
            if key == "between" and len(value) != 2:
                raise ValueError("between takes a pair of bounds")
            self._filters.append(Filter(name, KEYWORDS[key], tuple(value) if isinstance(value, list | set) else value))
        return self

    def where_null(self, name: str) -> QueryBuilder:
        return self.where_raw(Filter(name, Op.NULL))

    def where_not_null(self, name: str) -> QueryBuilder:
        return self.where_raw(Filter(name, Op.NOT_NULL))

    def where_within(self, name: str, latitude: float, longitude: float, radius: float) -> QueryBuilder:
        return self.where_raw(Filter(name, Op.WITHIN, Within(latitude, longitude, radius)))

    def any_of(self, conditions: Iterable[Condition]) -> QueryBuilder:
        return self.where_raw(Composite(Logic.OR, tuple(conditions)))

    def all_of(self, conditions: Iterable[Condition]) -> QueryBuilder:
        return self.where_raw(Composite(Logic.AND, tuple(conditions)))

    def where_raw(self, condition: Condition) -> QueryBuilder:
        self._filters.append(condition)
        return self

    def order_by(self, name: str, descending: bool = False, nulls_first: bool = False) -> QueryBuilder:
        self._sorting.append(Sort(name, descending, nulls_first))
        return self

    def limit(self, n: int) -> QueryBuilder:
        if n <= 0:
            raise ValueError("a limit is above 0")
        self._limit = n
        return self

    def offset(self, n: int) -> QueryBuilder:
        if n < 0:
            raise ValueError("an offset is 0 or more")
        self._offset = n
        return self

    def clear_filters(self) -> QueryBuilder:
        self._filters.clear()
        return self

    def clear_sorting(self) -> QueryBuilder:
        self._sorting.clear()
        return self

    def reset(self) -> QueryBuilder:
        self._limit = self._offset = None
        self.logic = Logic.AND
        return self.clear_filters().clear_sorting()

    def build(self) -> Query:
        return Query(tuple(self._filters), tuple(self._sorting), self._limit, self._offset, self.logic)


class FieldQuery(QueryBuilder):
    """A builder over declared fields. Subclasses name them, fields = {name: type or types}, and add tests of their own in their terms;
    a name that is not declared, or a value of another type, is an error when the query is built, not when it runs."""

    fields: dict[str, type | tuple[type, ...]] = {}

    def where(self, name: str, **tests: Any) -> FieldQuery:
        kinds = self._declared(name)
        for value in tests.values():
            for x in value if isinstance(value, list | set | tuple) else (value,):
                if x is not None and not isinstance(x, kinds):
                    raise TypeError(f"{name} is not compared with {type(x).__name__}")
        super().where(name, **tests)
        return self

    def where_raw(self, condition: Condition) -> FieldQuery:
        todo = [condition]
        while todo:
            x = todo.pop()
            todo += x.conditions if isinstance(x, Composite) else ()
            if isinstance(x, Filter):
                self._declared(x.field)
        super().where_raw(condition)
        return self

    def order_by(self, name: str, descending: bool = False, nulls_first: bool = False) -> FieldQuery:
        self._declared(name)
        super().order_by(name, descending, nulls_first)
        return self

    def _declared(self, name: str) -> type | tuple[type, ...]:
        if name not in self.fields:
            raise AttributeError(f"{type(self).__name__} has no field {name}")
        return self.fields[name]
