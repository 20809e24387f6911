"""Every query against its SQL, over the whole tables of the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

from quire.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    values = got.collect()
    assert values
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, values) == rows(want.columns, want.fetchall())
