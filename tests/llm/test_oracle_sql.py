"""Queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from quire.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    columns = ", ".join(got.columns)
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
