"""Whole indexes of Markdown, the modes of the reverse index, chat turns with history, and services."""

import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.plans import services, structure
from quire.plans.provider import Message, Reply, ask_rows


def kept(tmp_path, spark):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


def echo():
    """A provider that workers get by value, as they don't have this module."""

    def provider(prompt, history=None):
        return Reply("; ".join([*(f"{m.role}={m.content}" for m in history or ()), prompt.splitlines()[0]]))

    return provider


provider = echo()


DOCS = [(1, "# A\nshort\n## B\n" + "long words " * 90 + "\n# C\nend"), (2, "no headings"), (3, "")]


def test_index_markdown(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string")
    steps = []
    nodes = structure.index_markdown(docs, provider, kept(tmp_path, spark), structure.MarkdownOptions(add_description=True), structure.Progress(lambda *a: steps.append(a[0]), structure.MARKDOWN_STEPS))
    got = sorted((r.doc_id, r.node_id, r.title, r.summary, r.prefix_summary) for r in nodes.collect())
    assert [g[:3] for g in got] == [(1, "0000", "A"), (1, "0001", "B"), (1, "0002", "C")]
    assert got[0][4].endswith("short") and got[0][3] is None and "summary" in got[1][3] and got[2][3].endswith("end")
    assert steps[0] == "headings" and steps[-1] == "done" and "text" not in nodes.columns
    assert all("description" in r.doc_description for r in nodes.collect())
    plain = structure.index_markdown(docs, None, kept(tmp_path / "b", spark), structure.MarkdownOptions(thin=True, add_summaries=False, add_text=True))
    assert [(r.title, "long words" in r.text) for r in plain.orderBy("node_seq").collect()] == [("A", True), ("C", False)]
    with pytest.raises(ValueError, match="need a provider"):
        structure.index_markdown(docs, None, kept(tmp_path, spark))


def test_modes_of_the_reverse_index(spark):
    nodes = spark.createDataFrame([(1, 0, "Clay", "clay soil and sand; clay")], "doc_id long, node_seq int, title string, text string")
    got = [(r.term, r.tf, r["rank"]) for r in structure.reverse_index(nodes).orderBy("rank").collect()]
    assert got == [("clay", 4, 1), ("soil", 1, 2), ("sand", 1, 3)]
    terms = structure.reverse_index(nodes, "llm", lambda p, h=None: Reply('["Clay ", "x", "heavy soil"]'))
    assert [(r.term, r.score) for r in terms.orderBy("rank").collect()] == [("clay", 1.0), ("heavy soil", 0.5)]
    with pytest.raises(ValueError, match="needs a provider"):
        structure.reverse_index(nodes, "llm")
    with pytest.raises(ValueError, match="not known"):
        structure.reverse_index(nodes, "other")


def test_nodes_without_terms_and_long_ones(spark):
    rows = [(1, 0, "", ""), (1, 1, None, None), (1, 2, "the of", "12 to"), (2, 0, "", "aa bbb aaa bbb " * 5000)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_seq int, title string, text string")
    got = sorted((r.doc_id, r.node_seq, r.term, r.tf, r["rank"]) for r in structure.reverse_index(nodes).collect())
    assert got == [(2, 0, "aaa", 5000, 2), (2, 0, "bbb", 10000, 1)]


def test_terms_are_counted_without_a_shuffle(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "b")], "doc_id long, node_seq int, title string, text string")
    plan = structure.reverse_index(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_inputs():
    assert structure.checked_input("md", "# a") == "# a" and structure.checked_input("csv", b"a,b") == b"a,b"
    for kind, content in (("md", ""), ("md", b"x"), ("pdf", "x"), ("xlsx", None), ("csv", 3)):
        with pytest.raises(ValueError):
            structure.checked_input(kind, content)


def test_answers_with_history(spark):
    chat = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(14)], "conv_id long, turn long, role string, text string")
    asked = search.with_history(chat.where("turn in (0, 13)").select("conv_id", "turn"), chat)
    asked = asked.withColumn("prompt", search.user_turn(F.lit("found"), F.lit("why?")))
    got = {r.turn: r.reply for r in ask_rows(asked, provider, history="history").collect()}
    assert got[0] == "Relevant sections:" and got[13].startswith("user=m3; assistant=m4; ") and got[13].count("=m") == 10
    told = spark.range(1).select(search.system_turn(F.lit("x.pdf"), F.lit("crops")).alias("a"), search.system_turn(F.lit(None).cast("string")).alias("b")).first()
    assert '"x.pdf"' in told.a and "crops" in told.a and "the document" in told.b


@pytest.mark.parametrize("form,reply", [("choices", {"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}]}), ("content", {"content": [{"type": "text", "text": "hi"}], "stop_reason": "max_tokens"}), ("message", {"message": {"content": "hi"}, "done_reason": "length"})])
def test_services(form, reply):
    sent = []
    ask = services.Chat("http://here", "m", form, key="k", send=lambda *a: sent.append(a) or reply)
    assert ask("now", [Message("system", "rules"), Message("user", "before")]) == Reply("hi", "length")
    url, headers, body, _ = sent[0]
    assert url == "http://here" and body["model"] == "m" and body["messages"][-1] == {"role": "user", "content": "now"}
    assert (body.get("system") == "rules") == (form == "content") and ("k" in str(headers)) == (form != "message")


def test_large_sections_lose_their_former_parts():
    """A section that is taken apart gets new parts in place of those it had; parts as long as it are left."""
    texts = [f"page {i}" for i in range(1, 31)]
    options = structure.Options(max_pages_each_node=4, max_tokens_each_node=1)

    class Fixed(structure.Outliner):
        def ladder(self, mode, toc, places):
            n = len(self.texts)
            cuts = range(0, n, max(1, n // 3))
            return [{"structure": str(k), "title": f"{self.first}+{c}", "physical_index": self.first + c} for k, c in enumerate(cuts, 1)]

        def _with_starts(self, items):
            return [x | {"appear_start": "yes"} for x in items]

    original, structure.Outliner = structure.Outliner, Fixed
    try:
        whole = Fixed(lambda p, h=None: Reply("{}"), texts, lambda t: 1, options)
        items = [{"structure": "1", "title": "One", "physical_index": 1, "appear_start": "yes"}, {"structure": "2", "title": "Two", "physical_index": 21, "appear_start": "yes"}, {"structure": "2.1", "title": "Old", "physical_index": 29, "appear_start": "yes"}]
        codes = [x["structure"] for x in whole.refined(items)]
        items[2]["physical_index"] = 27  # the section above is from 21 to 26 now, and is taken apart
        titles = [x["title"] for x in whole.refined(items)]
    finally:
        structure.Outliner = original
    assert "Old" not in titles
    assert codes[0] == "1" and "1.1" in codes and "1.1.2" in codes and "2.1" in codes
    assert len(codes) == len(set(codes))
