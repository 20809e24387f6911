import hashlib
import random
import re

import duckdb
import pytest

from quire.llm import exact
from quire.llm.queries import ORACLES, op1_exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min(ids)
        for k, i in enumerate(sorted(ids)):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


ROWS = [(1, "a  b\n"), (0, "a b "), (2, None), (3, ""), (4, " "), (5, "\t\v\f\r"), (6, "é" * 41), (7, "é" * 41), (7, "é" * 41), (8, "é" * 40 + "f"), (9, "x" * 500), (10, "x" * 500), (11, "x" * 499 + "y")]


def rows_of(seed):
    r = random.Random(seed)
    return ROWS + [(100 + i, "".join(r.choice("ab ") for _ in range(r.choice([3, 8, 20, 33])))) for i in range(200)] + [(1000 + i, "same  text " * 9) for i in range(100)]


@pytest.mark.parametrize("block", [8])
def test_dedup(spark, block):
    rows = rows_of(block)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, keep_id string").repartition(3)
    got = exact.dedup(df, block=block).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in got) == sorted(brute(rows))


def test_shared_hashes(spark, monkeypatch):
    monkeypatch.setattr(exact, "_prints", lambda b: [exact.F.length(b).alias("h1"), exact.F.lit(0).alias("h2")])
    rows = rows_of(5)
    got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in got) == sorted(brute(rows))


def test_empty(spark):
    assert exact.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = duckdb.sql("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + ORACLES["op1_exact_dedup"] + ")").fetchall()
    assert sorted(map(tuple, op1_exact_dedup(spark, d).collect())) == sorted(want)


def test_distinct_documents(spark):
    rows = [(1, "a", "p"), (2, "a ", "q"), (2, "a ", "q"), (3, "a  ", "r"), (3, "b", "s"), (4, "c", "t"), (4, "c", "t"), (0, None, "u"), (9, "", "v")]
    got = exact.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.source for r in got) == ["p", "q", "s", "t", "u"]


def test_odd_rows(spark):
    long = "x y " * 40000
    rows = [("b", long, 1), ("a", long, 2), (None, long, 3), (None, None, 4), ("c", "", 5), ("c", "", 5), ("d", " ", 6), ("e", "\t\n", 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, id int").selectExpr("*", "id as gone_id", "id as sha", "id as gone_sha", "id as _sha", "id as rid")
    got = exact.distinct_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.id) for r in got.collect()) == [("a", 2), ("c", 5), ("d", 6)]
    assert exact.distinct_documents(df.limit(0)).count() == 0
