import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import licenses
from quire.llm.queries import op8_license_scan


def as_regex(template):
    """The markup as a regex over words that each end with one space."""
    out = ""
    for t in template.split():
        m = re.fullmatch(r"<(\d+)\.\.(\d+)>", t)
        out += {"[": "(?:", "]": ")?", "|": "|"}.get(t) or (rf"(?:\S+ ){{{m[1]},{m[2]}}}" if m else re.escape(t) + " ")
    return out


def brute(words):
    found = set()
    for i, j in itertools.combinations(range(len(words) + 1), 2):
        text = "".join(w + " " for w in words[i:j])
        for phrase, rules in ((True, licenses.PHRASES), (False, licenses.TEMPLATES)):
            for label, t in rules:
                if re.fullmatch(as_regex(t), text):
                    found.add((i, label, phrase, j))
    best = {}
    for i, label, phrase, j in found:
        best[i, label, phrase] = max(j, best.get((i, label, phrase), 0))
    return {(i, j, label, phrase) for (i, label, phrase), j in best.items()}


VOCAB = "cc by nc 4 0 licensed under the a general public license gnu all rights reserved copyright c x mit released version".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(VOCAB), max_size=13))
def test_like_regexes(words):
    assert {(m.start, m.end, m.label, m.phrase) for m in licenses.automaton().matches(words)} == brute(words)


def test_query(spark, tmp_path):
    texts = ["Licensed under CC BY-NC 4.0. x", None, "", "All rights  reserved.\nGNU General Public License", "naïve ALL RIGHTS", "word " * 50000 + "cc-by"]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, license_matches string").write.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in op8_license_scan(spark, d).collect()}
    assert [rows[i].n_base for i in range(6)] == [1, 0, 0, 2, 0, 1]
    assert rows[0].base_labels == "cc-by" and rows[0].labels == "cc,cc-by" and rows[0].first_word == 2
    assert rows[1].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[1].score == 0
    assert rows[3].base_labels == "gpl,reserved" and (rows[3].first_word, rows[3].last_word) == (0, 4)
    assert rows[4].n_words == 3 and rows[5].last_word == 50000
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_rows(spark):
    from quire.llm import licenses

    df = spark.sql("select 1 as spans, 'x' as license_words, cast(unhex('61FF20') as string) as text union all select 2, 'x', null union all select 2, 'x', null union all select 3, 'x', ''")
    assert licenses.scan(df).count() == 4 and licenses.scan(df.limit(0)).count() == 0
    assert set(df.columns) <= set(licenses.scan(df).columns)
