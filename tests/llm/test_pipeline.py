import math
import random
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, exact, jaccard, langid, mixing
from quire.llm.common import Scratch



def sets_of(text, size):
    w = text.split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    r = random.Random(11)
    words = {k: [f"{k}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiouy')}" + r.choice(["", "ing", "ten"]) for _ in range(120)] for k in ("th", "sch", "qu")}
    rows = []
    for i in range(150):
        k = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[k]) for _ in range(r.randint(20, 60))), k, r.choice("aab"), 1))
    rows += [(200 + i, rows[i][1], rows[i][2], "b", 1) for i in range(20)]
    for i in range(20):
        w = rows[30 + i][1].split()
        w[-1] = "zzz"
        rows.append((300 + i, " ".join(w), rows[30 + i][2], None, 1))
    return rows + [(400, None, "th", "a", 0), (401, "123 456 !!", None, "a", 9), (402, "", "th", None, 0)]


def test_each_stage_and_run(spark, tmp_path):
    rows = make()
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    ids = Counter(r.doc_id for r in got)
    # Language: no letters, no text. Exact: the later of equal texts. Near: one of each group, brute force.
    kept = [(i, t) for i, t, *_ in rows if i < 200 or 300 <= i < 400]
    sets, gone = {i: sets_of(t, 5) for i, t in kept}, set()
    for i in range(300, 320):
        j = i - 270
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            gone.add(i)
    allowed = {i for i, _ in kept} - gone
    assert set(ids) <= allowed and max(ids.values()) <= 3
    assert len(set(ids)) > 0.3 * len(allowed)
    enc = tiktoken.Encoding("w", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {i: t for i, t, *_ in rows}
    for r in got:
        assert r.text == text[r.doc_id] and r.ids == enc.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_equal_rows_in_stages(spark):
    a = ("one two three four five six seven eight",)
    rows = [(1, *a, "x"), (1, *a, "x"), (2, *a, "x"), (3, None, "x"), (3, None, "x"), (4, "", None), (1, "other words that are not like the ones above", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = Counter(map(tuple, jaccard.one_of_each(df).collect()))
    assert near == Counter([rows[0], rows[3], rows[4], rows[5], rows[6]])
    mixed = Counter(map(tuple, mixing.mixed_documents(df).collect()))
    assert all(n <= 3 * rows.count(k) for k, n in mixed.items()) and all(k[1] for k in mixed)
    assert len(exact.distinct_documents(df).collect()) == 3


def test_language_of_many_letters(spark):
    """Short clean texts of a language with 3,000 letters stay; texts unlike all languages go."""
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    weights = [(i + 1) ** -0.8 for i in range(20000)]
    many = ["".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in weights]
    few = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in weights]
    text = lambda words, n: " ".join(r.choices(words, weights, k=n))
    rows = [(i, text(many, (20, 50, 100, 400)[i % 4]), "zz", "a", 1) for i in range(400)]
    rows += [(1000 + i, text(few, (20, 50, 100, 400)[i % 4]), "la", "a", 1) for i in range(400)]
    junk = [(2000 + i, " ".join("".join(r.choice("αβγδεζηθικλμν") for _ in range(5)) for _ in range(40)), None, "a", 1) for i in range(20)]
    got = {x.doc_id for x in corpus_pipeline.language(spark, spark.createDataFrame(rows + junk + [(3000, None, "la", "a", 0), (3001, "1 2", "zz", "a", 0)], SCHEMA), "").collect()}
    assert len(got & {x[0] for x in rows}) >= 780
    assert not got - {x[0] for x in rows}


def test_bounds_of_all_labelled_rows(spark):
    """Bounds and profiles are of all labelled rows of a language, not of some."""
    r = random.Random(8)
    words = ["".join(r.choice([chr(0x4E00 + i) for i in range(3000)]) for _ in range(r.randint(2, 4))) for _ in range(9000)]
    rows = [(i, " ".join(r.choices(words, [(k + 1) ** -0.8 for k in range(9000)], k=20 + i % 4)), "zz", "a", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    train = F.col("doc_id") >= 0
    ranks = langid.fit(docs, train, most=None)
    grams = Counter()
    for x in rows:
        grams.update(dict(zip(*(a.tolist() for a in langid.counts(x[1])), strict=True)))
    assert ranks == {"zz": sorted(grams, key=lambda g: (-grams[g], g))[: langid.PROFILE_RANKS]}
    scores = {}
    for x in langid.predict(docs, ranks).collect():
        scores.setdefault(int(math.log2(len(x.text))), []).append(math.floor(x.lang_score * 10_000))
    want = {band: sorted(v)[math.ceil(len(v) / 20) - 1] / 20_000 for band, v in scores.items()}
    got = {x["_band"]: x["_least"] for x in corpus_pipeline.least_scores(docs, train, ranks).collect()}
    assert got == {band: want.get(band, min(want.values())) for band in range(64) if want.get(band, min(want.values())) < corpus_pipeline.LEAST_SCORE} and want


def test_odd_tables_in_each_stage(spark):
    """Empty tables, clashing names, nulls, repeated rows and a very long text."""
    rows = [*make()[:60], (None, "the " * 30000, "th", None, 1), (500, None, None, None, None), (500, None, None, None, None)]
    extra = ("_row", "_copy", "_band", "_lang", "lang_score", "lang_pred", "pred", "gone_id", "_sha", "n_tokens", "ids", "decoded", "id", "row", "node")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"concat('v', doc_id) as {c}" for c in extra))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            found = stage(spark, docs, "")
            own = [c for c in docs.columns if name != "encode" or c not in ("n_tokens", "ids")]
            assert [c for c in found.columns if c in own] == own and len(set(found.columns)) == len(found.columns)
            got = found.select(*own).collect()
            assert set(map(tuple, got)) <= set(map(tuple, docs.select(*own).collect())) or name == "encode"
            assert bool(got) == (docs is df)


def test_stages_end_without_python(spark):
    """As callers' settings may send Python whole tables in a batch, no stage leaves steps in Python to its caller."""
    docs = spark.createDataFrame([(i, f"the cat number{i} sat on this mat", "en", "a", 0) for i in range(20)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert "InArrow" not in docs._jdf.queryExecution().toString()
    assert docs.count()


def test_written_row_groups_are_bounded(spark):
    """64 MB in 64 values that can't be compressed: a task holds 32 MB of them and some more at once, not all."""
    import glob
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    def values(batches):
        for b in batches:
            for _ in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([os.urandom(1 << 20)], pa.binary())], names=["x"])

    scratch = Scratch(spark)
    assert scratch.write(spark.range(0, 64, 1, 1).mapInArrow(values, "x binary"), "x").count() == 64
    found = [pq.ParquetFile(f).metadata for f in glob.glob(scratch.root.removeprefix("file://") + "/*/*.parquet")]
    sizes = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
    assert sum(sizes) == 64 and max(sizes) <= 48


def test_stages_leave_no_tables_behind(spark, tmp_path, monkeypatch):
    """Stages leave ids and hashes, and the last its result; a run leaves no copy of the rows for each stage either."""
    from itertools import count
    from pathlib import Path

    from quire.llm import common

    def held():
        return sum(p.stat().st_size for p in shared.rglob("*.parquet"))

    shared, number = tmp_path / "shared", count()
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"{shared}/{next(number)}")
    r = random.Random(3)
    # Letters that can't be compressed; one long text is encoded in parts.
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(9000 if i == 5 else 1500)), "la", "a", 1) for i in range(40)]
    d = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    docs, size = spark.read.parquet(f"{d}/documents.parquet"), sum(p.stat().st_size for p in d.rglob("*.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at = held()
        found = stage(spark, docs, str(d))
        if name == "encode":
            out = held() - at
            assert found.count() == docs.count() and out < 2.5 * size
        else:
            assert held() - at < 0.1 * size, name
            found.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert docs.count()
    at = held()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], corpus_pipeline.STAGES[-1]])
    assert corpus_pipeline.run(spark, str(d)).count() == len(rows) and held() - at < out + 0.1 * size
