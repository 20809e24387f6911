import random

import duckdb
import numpy as np
import pytest

from quire.llm import topk
from quire.llm.queries import ORACLES, op4_top_k


def brute(rows, queries, k):
    out = []
    for qid, q in queries:
        hits = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in rows if i != qid)[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("low,high,n", [(-3, 3, 300), (0, 5, 200), (-600, 600, 400), (-(1 << 40), 1 << 40, 60)])
def test_max_score(low, high, n):
    r = np.random.default_rng(n)
    x = r.integers(low, high, (n, 9))
    ids = r.permutation(n).astype(np.int64)
    rows = [(int(i), [int(v) for v in row]) for i, row in zip(ids, x)]
    own = topk.Shard(ids, x.astype(topk._kind(int(abs(x).max()), int(abs(x).max()), 9)))
    for j in range(0, n, 7):
        at, score, _ = topk.max_score(own, int(ids[j]), x[j].astype(own.x.dtype), 10)
        got = [(int(ids[j]), rank, int(ids[a]), int(s)) for rank, (a, s) in enumerate(sorted(zip(at, score), key=lambda z: (-z[1], ids[z[0]])), 1)]
        assert got == brute(rows, [rows[j]], 10)


def test_postings_are_left_out_where_they_cannot_compete():
    r = np.random.default_rng(8)
    x = r.integers(1, 60, (2000, 80)) * (r.random((2000, 80)) < 0.05)
    x[:60, :6] += r.integers(200, 900, (60, 6))
    ids = np.arange(2000)
    own = topk.Shard(ids, x.astype(np.float64))
    read = 0
    for j in range(60):
        at, score, n = topk.max_score(own, j, x[j].astype(np.float64), 10)
        want = sorted((-int(x[i] @ x[j]), i) for i in range(2000) if i != j)[:10]
        assert [(-int(s), int(i)) for i, s in zip(at, score)] == want
        read += n
    assert read < 0.25 * 60 * np.count_nonzero(x)


def test_search(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(-4, 4) for _ in range(r.choice([6, 6, 4]))]) for i in range(500)] + [(900 + i, [4] * 6) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>").repartition(3)
    got = topk.search(df, df.where("vec_id % 25 = 0"), k=7, shard=60, block=5)
    assert got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows, [x for x in rows if x[0] % 25 == 0], 7)


def test_bad_vectors_and_empty(spark, tmp_path):
    rows = [(0, [0.5, 1.0]), (100, [0.25, -0.1]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [])]
    d = str(tmp_path)
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, q string").write.parquet(f"{d}/embeddings.parquet")
    assert {r.vec_id for r in op4_top_k(spark, d).where("query_id = 0").collect()} == {100, 5}
    none = spark.createDataFrame([], "vec_id long, q array<long>")
    assert topk.search(none, none).count() == 0


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = duckdb.sql("SELECT query_id, rank, vec_id, score FROM (" + ORACLES["op4_top_k"] + ")").fetchall()
    assert sorted(map(tuple, op4_top_k(spark, d).collect())) == sorted(want)
