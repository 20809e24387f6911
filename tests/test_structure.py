import pytest
from pyspark.sql import functions as F

from quire.operators import postings, search
from quire.plans import structure
from quire.plans.provider import Reply, RuleProvider, ask_rows, is_fatal, rate_limit_ms, with_retries

GUIDE = [
    "Crop guide",
    "Contents\n1 Soil ......... 1\n1.1 Clay ......... 2\n2 Water ......... 4\n2.1 Rain ......... 5",
    "1 Soil\nall about soil",
    "1.1 Clay\nheavy",
    "more of clay",
    "2 Water\nwet",
    "text\n2.1 Rain\nfalls",
]
PLAIN = ["1 Alpha\nx", "y", "2 Beta\nz", "2.1 Gamma\nq"]


def outliner(texts, **o):
    return structure.Outliner(RuleProvider(), texts, lambda t: -(-len(t) // 4), structure.Options(**o))


def test_contents_and_offset():
    items = outliner(GUIDE).items()
    assert [(x["title"], x["physical_index"], x["appear_start"]) for x in items] == [("Preface", 1, "no"), ("Soil", 3, "yes"), ("Clay", 4, "yes"), ("Water", 6, "yes"), ("Rain", 7, "no")]


def test_text_without_contents():
    assert [(x["structure"], x["physical_index"]) for x in outliner(PLAIN).items()] == [("1", 1), ("2", 3), ("2.1", 4)]


def test_numbered_lines_that_are_no_titles():
    """Addresses, card numbers, years and lists in a page's text, numbers on a line of their own, and lines like prompts."""
    odd = ["28.68.191.238 was seen", "4451718024887799\n27.65.93.188 and more", "1999 was a year\n## pages\nx", "12.\nand so", "56.187.231.175 at the end", "1 apple\n2 pears\n3 plums"]
    pages = [f"{n} Part {n}\ntext\n{odd[n % 6]}\nmore" for n in range(1, 11)]
    for most in (10**9, 40):  # all pages at once, and a few
        got = outliner(pages, max_tokens_each_node=most).items()
        assert [(x["structure"], x["title"], x["physical_index"], x["appear_start"]) for x in got] == [(str(n), f"Part {n}", n, "yes") for n in range(1, 11)]
    # One number left out, deeper levels, and a start that isn't 1.
    codes = ["3", "3.1", "3.1.1", "3.2", "5", "5.2.1", "6"]
    assert [x["structure"] for x in outliner([f"{c} Title\nx" for c in codes]).items()] == codes


def test_no_outline():
    with pytest.raises(ValueError):
        outliner(["nothing here", "nor here"]).items()


def test_groups():
    assert structure.groups_of([4] * 5, 8) == [[0, 1], [1, 2], [2, 3], [3, 4]]
    assert structure.groups_of([5] * 6, 10) == [[0, 1], [1, 2], [2, 3], [3, 4], [4, 5]]
    assert structure.groups_of([30, 4, 4], 10) == [[], [0], [0, 1], [1, 2]]


def test_refine():
    texts = ["1 Big\nstart"] + [f"1.{k} Part {k}\n" + "w " * 40 for k in range(1, 7)] + ["2 End\nx"]
    o = outliner(texts, max_pages_each_node=2, max_tokens_each_node=20)
    top = [{"structure": "1", "title": "Big", "physical_index": 1, "appear_start": "yes"}, {"structure": "2", "title": "End", "physical_index": 8, "appear_start": "yes"}]
    got = o.refined(top)
    assert [x["title"] for x in got][:3] == ["Big", "Part 1", "Part 2"] and got[-1]["title"] == "End"


def test_build_and_llm_index(spark, tmp_path):
    rows = [(d, i, t, -(-len(t) // 4)) for d, texts in (("g", GUIDE), ("p", PLAIN), ("n", ["none"])) for i, t in enumerate(texts, 1)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, token_count int")

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    seen = []
    nodes = structure.build(pages, RuleProvider(), write, progress=structure.Progress(lambda *a: seen.append(a)))
    got = {(r.doc_id, r.title): r for r in nodes.collect()}
    assert (got["g", "Preface"].start_index, got["g", "Preface"].end_index) == (1, 2)
    assert (got["g", "Water"].start_index, got["g", "Water"].end_index) == (6, 7)
    assert got["g", "Clay"].node_id == "0002" and got["g", "Clay"].parent_index == 1 and got["g", "Clay"].is_leaf
    assert got["p", "Beta"].summary.startswith("2 Beta") and seen[0] == ("look for contents", 8, None)
    about = {r.doc_id: r.doc_description for r in structure.descriptions(nodes, RuleProvider()).collect()}
    assert "Soil" in about["g"]
    terms = structure.concept_terms(nodes, RuleProvider(), 3)
    index = postings.build_from_terms(terms.withColumn("doc_id", F.lit("all")).withColumn("node_seq", F.monotonically_increasing_id()))
    found = search.search(index, spark.createDataFrame([(1, "gamma")], "query_id int, query string"), 3).collect()
    assert found and found[0].title == "Gamma"


def test_nested():
    flat = [{"list_index": 0, "parent_index": None, "title": "a"}, {"list_index": 1, "parent_index": 0, "title": "b"}, {"list_index": 2, "parent_index": None, "title": "c"}]
    assert structure.nested(flat) == [{"title": "a", "nodes": [{"title": "b"}]}, {"title": "c"}]


def test_retries():
    waits, calls = [], []

    def flaky(text, history):
        calls.append(text)
        if len(calls) == 1:
            raise OSError("429 try again in 1.5s")
        if len(calls) == 2:
            raise OSError("500")
        return Reply("ok")

    assert with_retries(flaky, sleep=waits.append)("q").content == "ok" and waits == [2.0, 1.0]

    def refused(text, history):
        raise OSError("401 no")

    with pytest.raises(RuntimeError):
        with_retries(refused, sleep=waits.append)("q")
    assert len(waits) == 2 and is_fatal("invalid API key") and rate_limit_ms("429") == 8500 and rate_limit_ms("x") is None


def test_ask_rows(spark):
    df = spark.createDataFrame([(1, "# task: summary\nx\n## text\nalpha beta"), (2, None)], "id int, prompt string")
    assert [r.reply for r in ask_rows(df, RuleProvider()).orderBy("id").collect()] == ["alpha beta", None]


def test_document_type():
    assert [structure.document_type(n) for n in ("a.PDF", "b.ods", "c.markdown")] == ["pdf", "xlsx", "md"]
    with pytest.raises(ValueError):
        structure.document_type("a.zip")
    assert structure.read_json('```json\n[{"a": None,},]\n```', []) == [{"a": None}] and structure.read_json("x", {}) == {}


def test_paths_of_any_depth(spark):
    from quire.operators import outline

    codes = [".".join(["1"] * n) for n in range(1, 13)] + ["2", "1.2"]
    items = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)] + [(2, 0, "9.9")], "doc_id long, list_index int, structure string")
    got = {(r.doc_id, r.list_index): (r.path, r.node_id) for r in outline.with_paths(outline.with_parents(items)).collect()}
    assert all(got[1, n] == (list(range(n + 1)), f"{n:04}") for n in range(12))
    assert got[1, 13] == ([0, 13], "0012") and got[1, 12] == ([12], "0013") and got[2, 0] == ([0], "0000")
