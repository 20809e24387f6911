import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe
from quire.llm.queries import op10_byte_bpe

VOCAB = P.path("byte_bpe_50k.tiktoken")
WHOLE = tiktoken.Encoding("w", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(VOCAB), special_tokens={})
SMALL = bpe.Coder(VOCAB, P.PATTERN, chunk=16, overlap=5)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab 1'ts\n\t é中!?  \x1c\x1d\x85\u180e\u200b\u2028\u3000²½\x0b\x0c\r"), max_size=160))
def test_chunks_stitch_to_the_whole_encoding(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 300, " " * 300 + "x", "  " * 80, "<|endoftext|>" * 9, "1" * 99 + " b"])
def test_runs_longer_than_chunk_and_overlap(text):
    assert SMALL.encode(text) == WHOLE.encode_ordinary(text)


def test_frame(spark, tmp_path):
    rows = [(1, "Hello  world's 42", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello  world's 42", "x"), (4, "ab " * 90000, "l")]
    d = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    df.write.parquet(f"{d}/documents.parquet")
    out = bpe.decode(bpe.encode(df, VOCAB, P.PATTERN), VOCAB, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out) and len(out) == 5
    got = sorted(tuple(r) for r in op10_byte_bpe(spark, d).collect())
    want = []
    for i, t, _ in rows:
        ids = WHOLE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert op10_byte_bpe(spark, d).limit(0).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdefghij ntheiostr'.é中"), max_size=90), max_size=6))
def test_merges_are_the_librarys(words):
    ids, count = SMALL.encode_all(words)
    want = [WHOLE._encode_single_piece(w) if w else [] for w in words]
    assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own = bpe.Coder(VOCAB, P.PATTERN, chunk=64, overlap=16)
    for i in range(30):
        text = " ".join(f"word{i * j} über{j} {'x' * (j * 7)}" for j in range(12))
        assert own.encode(text) == WHOLE.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_long_texts_in_rows_of_parts(spark):
    words = "Some words, 12 numbers  and\n\n spaces's "
    long = [words * 9, words[3:] * 20, "a" * 400, " " * 300 + "b", words * 3 + "é" * 200 + words * 4, "x y " * 80]
    rows = [(i, t, "k") for i, t in enumerate([*long, long[0], None, "", "short"])]
    df = spark.createDataFrame(rows, "doc_id int, text string, rid string").selectExpr("*", "rid as own", "rid as found", "rid as no", "rid as head", "rid as part")
    out = bpe.encode(df, VOCAB, P.PATTERN, long=100, part=64, lap=24)
    assert out.columns == [*df.columns, "ids"] and out.count() == len(rows)
    for r in out.collect():
        assert r.ids == WHOLE.encode_ordinary(r.text or "") and r.rid == "k"


def test_bytes_that_are_not_text(spark):
    df = spark.sql("select cast(unhex('61FF62') as string) as text")
    out = bpe.decode(bpe.encode(df, VOCAB, P.PATTERN), VOCAB, P.PATTERN).select("decoded").collect()
    assert bytes(out[0].decoded) == "a\ufffdb".encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, VOCAB, P.PATTERN), VOCAB, P.PATTERN).count() == 0
