import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from replicaql.errors import UnsupportedFilter
from replicaql.plans.compiler import apply, count, first, predicate
from replicaql.plans.model import Composite, Filter, Logic, Op, Query, QueryBuilder, Within

ROWS = [(1, "Apple", 10, ["a", None], Row(latitude=0.0, longitude=0.0)), (2, "Banana", 20, ["b"], Row(latitude=0.0, longitude=1.0)), (3, "a%b", 30, [], Row(latitude=None, longitude=1.0)), (4, None, None, None, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, name string, value int, tags array<string>, place struct<latitude:double,longitude:double>").cache()


TESTS = [
    (Filter("value", Op.EQ, 10), [1]), (Filter("value", Op.EQ, None), []), (Filter("value", Op.NE, 10), [2, 3]), (Filter("value", Op.NE, None), [1, 2, 3]),
    (Filter("value", Op.GT, 10), [2, 3]), (Filter("value", Op.GE, 20), [2, 3]), (Filter("value", Op.LT, 20), [1]), (Filter("value", Op.LE, 20), [1, 2]), (Filter("value", Op.GT, None), []),
    (Filter("name", Op.CONTAINS, "a%"), [3]), (Filter("name", Op.CONTAINS_CI, "APP"), [1]), (Filter("name", Op.STARTS, "B"), [2]), (Filter("name", Op.ENDS, "e"), [1]),
    (Filter("value", Op.IN, (10, None)), [1]), (Filter("value", Op.IN, ()), []), (Filter("value", Op.IN, 3), []), (Filter("value", Op.NOT_IN, (10, None)), [2, 3]), (Filter("value", Op.NOT_IN, ()), [1, 2, 3]),
    (Filter("name", Op.NULL), [4]), (Filter("name", Op.NOT_NULL), [1, 2, 3]), (Filter("tags", Op.ARRAY_CONTAINS, "b"), [2]), (Filter("tags", Op.ARRAY_ANY, ("b", "z")), [2]), (Filter("tags", Op.ARRAY_ANY, ()), []),
    (Filter("name", Op.MATCHES, "an+a"), [2]), (Filter("place", Op.WITHIN, Within(0, 0, 1000)), [1]), (Filter("place", Op.WITHIN, Within(0, 0, 111_200)), [1, 2]), (Filter("place", Op.WITHIN, Within(0, 180, 2e7)), [2]),
    (Filter("value", Op.BETWEEN, (10, 20)), [1, 2]), (Filter("value", Op.BETWEEN, (10,)), []), (Filter("place.longitude", Op.EQ, 1.0), [2, 3]),
    (Composite(Logic.AND), [1, 2, 3, 4]), (Composite(Logic.OR), []), (Composite(Logic.OR, (Filter("value", Op.EQ, 10), Filter("name", Op.NULL))), [1, 4]),
]


@pytest.mark.parametrize("condition,ids", TESTS)
def test_predicate(df, condition, ids):
    assert sorted(r.id for r in df.where(predicate(condition)).collect()) == ids


def test_roots(df):
    assert df.count() == apply(df, Query(logic=Logic.OR)).count() == 4
    assert apply(df, QueryBuilder(logic=Logic.OR).where("value", eq=10).where("value", eq=20).build()).count() == 2
    with pytest.raises(UnsupportedFilter):
        predicate(object())
    assert apply(df, Query((Filter("x", Op.EQ, 1),)), custom=lambda f: F.col("id") == 3).first().id == 3


def test_order(df):
    order = lambda b: [r.id for r in apply(df, b.build(), ("id",)).collect()]
    assert order(QueryBuilder().order_by("value", True)) == [3, 2, 1, 4]
    assert order(QueryBuilder().order_by("value", True, nulls_first=True)) == [4, 3, 2, 1]
    assert order(QueryBuilder().order_by("value").offset(1).limit(2)) == [2, 3]
    assert first(df, QueryBuilder().order_by("value", True).build()).first().id == 3
    assert count(df, QueryBuilder().where("value", gt=10).build()).first().n == 2


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = apply(df, QueryBuilder().where("o_orderstatus", is_in=["O"]).where("o_totalprice", gt=5.0).build()).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_total" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
