import math

import duckdb
import pytest

import __spark_entry__ as entry
from replicaql.plans import catalogue

DIR = "/root/testdata/sf0.001"


def _norm(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else int(v) if type(v).__name__ == "Decimal" else v


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    r = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(_norm(g[names.index(c)]) for c in columns) for g in r.fetchall()), key=repr)
    assert sorted((tuple(_norm(x[c]) for c in columns) for x in df.collect()), key=repr) == want
