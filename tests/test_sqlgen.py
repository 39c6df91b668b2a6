import pytest

from replicaql.errors import UnsupportedFilter
from replicaql.plans.model import Composite, Condition, Filter, Logic, Op, Query, QueryBuilder
from replicaql.plans.sqlgen import to_sql

HEAD = 'SELECT * FROM "items"'


def q(**o):
    return QueryBuilder(**o)


CASES = [
    (q().where("completed", eq=False), "sqlite", 'WHERE "completed" = ?', [False]),
    (q().where("priority", gt=2).where("status", ne="archived"), "sqlite", 'WHERE "priority" > ? AND "status" != ?', [2, "archived"]),
    (q(logic=Logic.OR).where("priority", gt=4).where("status", eq="urgent"), "sqlite", 'WHERE "priority" > ? OR "status" = ?', [4, "urgent"]),
    (q().order_by("createdAt", True).limit(10).offset(20), "sqlite", 'ORDER BY "createdAt" DESC NULLS LAST LIMIT 10 OFFSET 20', []),
    (q().where("name", contains="test").where("value", le=100), "postgresql", 'WHERE "name" LIKE $1 AND "value" <= $2', ["%test%", 100]),
    (q().where("status", is_in=["new", "open"]).where("id", not_in=["id1", "id2"]), "sqlite", 'WHERE "status" IN (?, ?) AND "id" NOT IN (?, ?)', ["new", "open", "id1", "id2"]),
    (q().where("status", is_in=[]), "sqlite", "WHERE 0=1", []),
    (q().where("status", not_in=[]), "sqlite", "WHERE 1=1", []),
    (q().where("at", between=[1, 2]), "sqlite", 'WHERE "at" BETWEEN ? AND ?', [1, 2]),
    (q().where_null("deletedAt").where_not_null("updatedAt"), "sqlite", 'WHERE "deletedAt" IS NULL AND "updatedAt" IS NOT NULL', []),
    (q().where("name", starts="prefix").where("path", ends=".txt"), "sqlite", 'WHERE "name" LIKE ? AND "path" LIKE ?', ["prefix%", "%.txt"]),
    (q().where("value", ge=10).where("priority", lt=3), "sqlite", 'WHERE "value" >= ? AND "priority" < ?', [10, 3]),
    (q().where("name", contains_ci="Case"), "sqlite", 'WHERE LOWER("name") LIKE ?', ["%case%"]),
    (q().where("name", contains_ci="Case"), "postgresql", 'WHERE "name" ILIKE $1', ["%Case%"]),
    (q().where("c", eq="A").any_of([Filter("s", Op.EQ, "new"), Filter("p", Op.GT, 3)]), "sqlite", 'WHERE "c" = ? AND ("s" = ? OR "p" > ?)', ["A", "new", 3]),
    (q(logic=Logic.OR).where("c", eq="A").all_of([Filter("s", Op.EQ, "x"), Filter("p", Op.LT, 2)]), "sqlite", 'WHERE "c" = ? OR ("s" = ? AND "p" < ?)', ["A", "x", 2]),
    (q().order_by("priority", True).order_by("createdAt", nulls_first=True), "sqlite", 'ORDER BY "priority" DESC NULLS LAST, "createdAt" ASC NULLS FIRST', []),
    (q().where("name", matches="p"), "postgresql", 'WHERE "name" ~ $1', ["p"]),
    (q().where("name", matches="p"), "sqlite", 'WHERE "name" REGEXP ?', ["p"]),
]


@pytest.mark.parametrize("builder,dialect,text,params", CASES)
def test_text(builder, dialect, text, params):
    assert to_sql(builder.build(), "items", dialect) == (f"{HEAD} {text}", params)


class Odd(Condition):
    pass


@pytest.mark.parametrize("query", [q().where("t", array_contains="x").build(), q().where("t", array_any=["x"]).build(), q().where_within("l", 0, 0, 100).build(), Query((Odd(),))])
def test_unsupported(query):
    with pytest.raises(UnsupportedFilter):
        to_sql(query, "items")


def test_custom():
    with pytest.raises(ValueError):
        to_sql(q().build(), "items", "custom")
    with pytest.raises(UnsupportedFilter):
        to_sql(q().where("n", matches="p").build(), "items", "custom", placeholder=lambda i: "?")
    assert to_sql(q().where("n", eq="t").build(), "items", "custom", placeholder=lambda i: f"@p{i}") == (f'{HEAD} WHERE "n" = @p1', ["t"])

    def own(f, mark, params):
        params.append(f.value)
        return f'"{f.field}" REGEXP {mark()}'

    assert to_sql(q().where("l", matches="some").build(), "items", custom=own) == (f'{HEAD} WHERE "l" REGEXP ?', ["some"])


def test_builder():
    b = q().where("a", eq=1, gt=None).limit(3).offset(2).order_by("a")
    assert len(b.build().filters) == 1
    assert b.clear_filters().build().filters == () and b.clear_sorting().build().sorting == ()
    assert b.where("x", eq=1).reset().build() == Query()
    for bad in (lambda: q().limit(0), lambda: q().offset(-1), lambda: q().where("a", between=[1])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        q().where("a", like="x")
    assert Query(limit=3).replace(limit=None, offset=1) == Query(limit=3, offset=1)
    assert Composite(Logic.AND).conditions == ()


def test_quotes_in_names():
    q = QueryBuilder().where('a" OR 1=1 --', eq=1).order_by('b"c').build()
    assert to_sql(q, 't"; DROP TABLE x; --') == ('SELECT * FROM "t""; DROP TABLE x; --" WHERE "a"" OR 1=1 --" = ? ORDER BY "b""c" ASC NULLS LAST', [1])
