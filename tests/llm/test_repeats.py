import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quire.llm import repeats
from quire.llm.queries import op2_substring_dedup
from quire.llm.wordhash import words_of


def brute(rows, window=13):
    words = {}
    first = {}
    for i, t in rows:
        w = words[i, t] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words[i, t]
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_word_hashes():
    texts = ["a b", None, "", " ", "b  a\n", "ab", "B a", "é x a"]
    h, doc, first = words_of(pa.array(texts).slice(0))
    assert doc.tolist() == [0, 0, 4, 4, 5, 6, 6, 7, 7]
    assert h[0] == h[3] == h[6] == h[8] and h[1] == h[2] != h[5] and len(set(h.tolist())) == 5
    low = words_of(pa.array(texts).slice(4), lower=True)
    assert low[1].tolist() == [0, 0, 1, 2, 2, 3, 3] and low[0][0] == low[0][3]
    assert len(words_of(pa.array([None, ""], pa.string()))[0]) == 0


def make(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "the"]
    shared = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 30, 60]))] for _ in range(12)]
    line = [r.choice(vocab) for _ in range(9)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(r.randint(0, 5)):
            w += [r.choice(vocab) for _ in range(r.choice([0, 3, 15]))] + r.choice([*shared, line * r.choice([1, 3])])
        rows.append((r.randint(0, 400) if i % 9 == 0 else 1000 + i, r.choice([" ", "  ", "\n"]).join(w) if w else r.choice([None, "", " "])))
    return rows + [rows[3], rows[3], (7, rows[3][1]), (5000, " ".join(vocab * 90)), (5001, "zz " + " ".join(vocab * 90))]


def test_extension_meets_pairs_compared_word_by_word():
    r = random.Random(5)
    for _ in range(60):
        n, most = r.randint(1, 30), 8
        key = np.array([r.randrange(3) for _ in range(n)])
        ids = np.array([r.randrange(12) for _ in range(n)])
        low = np.array([r.randrange(9) for _ in range(n)])
        high = np.array([r.randint(x, 8) for x in low.tolist()])
        left, right = (np.array([[r.choice([1, 1, 1, 2]) for _ in range(most)] for _ in range(n)], np.uint64) for _ in "xy")
        want = set()
        for i in range(n):
            for j in range(n):
                if key[i] == key[j] and ids[j] < ids[i]:
                    a = next((k for k in range(most) if left[i][k] != left[j][k]), most)
                    e = next((k for k in range(most) if right[i][k] != right[j][k]), most)
                    want |= {(i, k) for k in range(max(low[i], low[j], most - e), min(high[i], high[j], a) + 1)}
        got = {(i, a) for found, a in repeats.extended(key, ids, low, high, left, right) for i in found.tolist()}
        assert got == want


def test_anchors_hold_all_windows():
    col = pa.array([t for _, t in make(1)])
    hashes, doc, first = words_of(col)
    start, at, seed = repeats.windows_of(hashes, doc, 13, 5)
    where, found, begin, end = repeats.anchors_of(hashes, doc, 13, 5)
    assert sum(end - begin + 1) == len(start) and ((where - end >= 0) & (where - begin <= 8)).all()
    assert {(int(a), int(s)) for a, s in zip(at, seed)} == {(int(a), int(s)) for a, s in zip(where, found)}


def test_stretches():
    rows = lambda *x: np.array([repeats._mark(a, e) for a, e in x], np.int64)
    assert repeats.stretches(rows((9, 9), (2, 3), (3, 3), (30, 30), (16, 22)), 13) == [(2, 43)]
    assert repeats.stretches(rows((40, 40), (2, 20), (4, 4)), 13) == [(2, 33), (40, 53)] and repeats.stretches(rows(), 13) == []


def test_ranges():
    r = random.Random(2)
    for _ in range(200):
        marks = [(r.randrange(3), r.randrange(60)) for _ in range(r.randrange(12))]
        marks = [(k, a, a + r.randrange(9)) for k, a in marks]
        covered = {(k, w) for k, a, e in marks for w in range(a, e + 5)}
        key, start, last = repeats.ranges(*(np.array([m[i] for m in marks], np.int64) for i in range(3)), 5)
        assert sorted((k, w) for k, a, e in zip(key.tolist(), start.tolist(), last.tolist()) for w in range(a, e + 5)) == sorted(covered)


def check(spark, rows, kind="long", **more):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    found = repeats.remove(df, **more).collect()
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found)


def test_frequent_anchors_are_split(spark):
    rows = make(12)
    assert check(spark, rows, group=6) == brute(rows)


def test_ids_of_strings(spark):
    rows = [(f"id{i:05d}", t) for i, t in make(13)]
    assert check(spark, rows, "string") == brute(rows)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(60000))
    rows = [(None, passage, "a"), (3, passage, "b"), (3, passage, "b"), (4, f"{long} {passage}", "c"), (5, f"q {long}", "d"), (6, None, None), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "row as of", "row as starts", "row as whole", "row as stretches", "row as h", "row as id", "row as _row", "row as `order`", "1 as kept")
    found = repeats.remove(df)
    assert found.columns == [*(c for c in df.columns if c != "kept"), "n_words", "n_removed", "kept"]
    got = sorted(((r.doc_id, r.starts, r.n_words, r.n_removed) for r in found.collect()), key=str)
    assert got == sorted([(None, "a", 20, 20), (3, "b", 20, 0), (3, "b", 20, 0), (4, "c", 60020, 20), (5, "d", 60001, 60000), (6, None, 0, 0), (7, None, 0, 0)], key=str)


def test_bytes_that_are_not_text(spark):
    words = "|| ' ' || ".join(f"'w{i}'" for i in range(13))
    df = spark.sql(f"select id as doc_id, cast(unhex('FF20') as string) || {words} as text from range(2)")
    assert {(r.doc_id, r.n_words, r.n_removed) for r in repeats.remove(df).select("doc_id", "n_words", "n_removed").collect()} == {(0, 14, 0), (1, 14, 14)}


def test_query(spark, tmp_path):
    rows = make(99)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(3).write.parquet(f"{d}/documents.parquet")
    assert sorted(map(tuple, op2_substring_dedup(spark, d).collect())) == brute(rows)


def test_empty(spark):
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0
