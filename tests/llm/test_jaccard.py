import glob
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import jaccard
from quire.llm.common import Scratch
from quire.llm.components import components
from quire.llm.queries import op7_jaccard_join


def sets_of(text, size=3):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def make(seed, n=150):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["É", "Aa", "aA"]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 30, 60, 90]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(base[:4] if i % 3 else base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((1000 - i, r.choice([" ", "\n", "  "]).join(w)))
    return [*rows, (5, None), (6, ""), (7, " \t"), rows[0], (rows[1][0], rows[2][1]), (9, "x y z " * 20000)]


def test_sets():
    texts = ["a b c d", None, "A  b", "", "a b", "a b c d a b c", "a"]
    grams, at = jaccard.shingle_sets(pa.array(texts), 3)
    assert np.diff(at).tolist() == [len(sets_of(t)) for t in texts]
    assert grams[at[2]] == grams[at[4]] and set(grams[at[0] : at[1]]) < set(grams[at[5] : at[6]])


@pytest.mark.parametrize("seed,long", [(1, 32), (2, 6)])
def test_query(spark, tmp_path, monkeypatch, seed, long):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = make(seed)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3).write.parquet(f"{d}/documents.parquet")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op7_jaccard_join(spark, d).collect())
    assert got == brute(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for x, label in got.items():
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert label == min(seen)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("piece", [3, 8])
def test_long_lists_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LONG", 2)
    rows = make(7, 90)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), piece=piece)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows)


def test_signatures_never_rule_out_what_is_similar():
    r = random.Random(3)
    for _ in range(300):
        n = r.choice([1, 2, 5, 40, 400])
        x = {r.getrandbits(64) for _ in range(n)}
        y = {g for g in x if r.random() > 0.06} | {r.getrandbits(64) for _ in range(r.randrange(1 + n // 20))}
        rows = np.zeros(2, jaccard._ENTRY)
        grams = [np.array(sorted(g), np.uint64) for g in (x, y)]
        rows["n"], rows["sig"] = [len(x), len(y)], jaccard.signatures(np.concatenate(grams), np.array([0, len(x), len(x) + len(y)]))
        alike = jaccard._alike(rows, np.array([0]), rows, np.array([1]), 9, 10)[0]
        assert alike or 10 * len(x & y) < 9 * len(x | y)


def test_one_of_each_with_odd_rows(spark):
    long = "a b c d e f " * 30000
    rows = [("p", "a b c d e f g", 1), ("q", "a b c d e f g", 2), (None, "a b c d e f g", 3), ("r", None, 4), ("r", None, 4), ("s", "", 5), ("t", long, 6), ("t", long, 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, row int").withColumnsRenamed({"row": "id"}).selectExpr("*", "id as row", "id as kept", "id as node")
    got = sorted(((r.doc_id, r.text, r.id) for r in jaccard.one_of_each(df).collect()), key=str)
    assert got == sorted([("p", "a b c d e f g", 1), ("r", None, 4), ("r", None, 4), ("s", "", 5), ("t", long, 6), (None, None, 7)], key=str)
    assert jaccard.one_of_each(df).columns == df.columns
    assert jaccard.one_of_each(df.limit(0)).count() == 0
    odd = spark.sql("select id as doc_id, cast(unhex('61FF62') as string) as text from range(2)")
    assert {r.component_id for r in jaccard.near_duplicates(odd).collect()} == {0}


def test_pivots_leave_few_pairs(spark, monkeypatch):
    """A group of copies of which most are like a few only: pivots join it, so its pairs aren't all met."""
    monkeypatch.setattr(jaccard, "LONG", 8)
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(200):
        words = list(base)
        for at in r.sample(range(5, 195), 1 if i % 16 == 7 else 3):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    s = Scratch(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df, 4, 5, 5, scratch=s).collect()
    assert {x.component_id for x in got} == {0}
    (last,) = glob.glob(f"{s.root}/*-pairs-last")
    assert spark.read.parquet(last).count() < 2 * len(rows)


def test_several_pivots_in_a_round():
    rows = np.zeros(20, jaccard._ENTRY)
    rows["gram"], rows["node"], rows["n"], rows["l"], rows["long"], rows["long_n"] = 7, range(20), 50, 1, 1, 1
    batch = pa.RecordBatch.from_arrays([pa.array([rows.tobytes()]), pa.array([np.arange(20).tobytes()])], names=["rows", "labels"])
    data = b"".join(x for b in jaccard._stars([batch], 0, 4, 4, 5) for x in b.column("rows").to_pylist())
    got = sorted((p["a"], p["b"], p["shared"]) for p in np.frombuffer(data, jaccard._PAIR))
    assert got == [(i, j, 1) for i in range(8) for j in range(i + 1, 20)]
