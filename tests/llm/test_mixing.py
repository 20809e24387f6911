import random
from collections import Counter

import pytest

from quire.llm.mixing import mix, mixed_documents
from quire.llm.queries import op5_mix_sources


def brute_targets(sizes):
    """Share by weight, cap, share the excess again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, total, capped = {}, sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", [1])
def test_mix(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        source = r.choice(["a", "a", "a", "b", "c", "é", None, "tiny" if r.random() < 0.02 else "d"])
        text = r.choice([None, "", " \t", " x\n y ", "w " * r.randint(1, 80), "w " * 3000 if r.random() < 0.01 else "q"])
        rows.append((i, text, source, 7))
    rows += [rows[5]] * 40
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3).write.parquet(f"{d}/documents.parquet")
    got = op5_mix_sources(spark, d).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    source_of = {i: s for i, _, s, _ in rows}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for g in got:
        s = source_of[g.doc_id]
        assert g.source_size == sizes[s] and g.target == pytest.approx(want[s])
        assert g.taken % max(g.size, 1) == 0 and g.taken <= 3 * g.size
        e = g.target / g.source_size if g.source_size else 0
        if g.doc_id != 5 and g.size:
            assert int(e + 1e-9) <= g.taken // g.size <= int(e + 1)
        taken[s] = taken.get(s, 0) + g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(g.size for g in got if source_of[g.doc_id] == s)
    again = op5_mix_sources(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_chances_are_kept(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    mean, n = {}, 5
    for seed in range(n):
        for r in mix(df, seed=1000 * seed, fan=4).collect():
            mean[r.doc_id] = mean.get(r.doc_id, 0) + r.copies / n
    spread = [mean[i] - 2 / 3 for i in range(0, 40, 2)]
    assert abs(sum(spread) / 20) < 0.15 and max(map(abs, spread)) < 0.9


def test_long_documents_meet_first(spark):
    """Sources with a few very long documents still come near their targets: by less than one of these, and by 5%."""
    r = random.Random(6)
    rows = [(i, "w " * (r.randint(2000, 6000) if i % 40 == 0 else r.randint(1, 30)), r.choice("abc")) for i in range(1500)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg({"*": "count"}).collect()
    taken = {}
    for x in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
    for x in found:
        assert abs(taken[x.source] - x.target) <= min(6000, 0.05 * x.target)


def test_columns_and_nulls_of_documents(spark):
    rows = [(None, "a b", None, "k")] * 3 + [(1, "a b c", "s", "k"), (1, "a b c", "s", "k"), (2, None, "s", "k"), (3, "long " * 9000, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, id string").selectExpr("*", "id as of", "id as total", "id as copy", "id as rows", "id as n", "id as size", "id as target")
    got = Counter(map(tuple, mixed_documents(df).collect()))
    assert all(k in set(map(tuple, df.collect())) for k in got) and all(n <= 3 * rows.count(k[:4]) for k, n in got.items())
    assert mixed_documents(df).columns == df.columns and mixed_documents(df.limit(0)).count() == 0


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
