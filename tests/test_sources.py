import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import markdown, postings, search
from quire.sources import csv_pages, html, sheets, text_pages


@pytest.mark.parametrize(
    "text,want",
    [
        ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
        ('a , "b, c" \r\n\r\n"x ""y"" z",""\r', [["a", "b, c"], ['x "y" z', ""]]),
        ('"two\n\nlines",2', [["two\n\nlines", "2"]]),
        ('ab"c,d"e,f\nshort', [["abc,de", "f"], ["short"]]),
        ('open "quote\nstays', [["open quote\nstays"]]),
        ("", []),
    ],
)
def test_csv_rows(text, want):
    assert csv_pages.parse_text(text, ",") == want


def test_csv_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;name\n".encode() + b"".join(b"%d;n%d\n" % (i, i) for i in range(105)))
    (tmp_path / "b.csv").write_text("only;header")
    got = csv_pages.read(spark, str(tmp_path), rows_per_page=10).collect()
    pages = {(r.doc_id[-5:], r.page_no): r.text for r in got}
    assert pages["a.csv", 1].splitlines()[:5] == ["[CSV Data — Rows 1–10 of total, Page 1/11]", "", "id | name", "----|-----", "0 | n0"]
    assert pages["a.csv", 11].startswith("[CSV Data — Rows 51–55 of total, Page 11/11]")
    assert pages["b.csv", 1] == "only | header\n-----|-------"
    with pytest.raises(ValueError):
        csv_pages.parse(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "ab")


def test_sheets(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si><si><r><t>lo</t></r><r><t>ng value</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row/><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7.0</v></c><c r="D2"><v>9</v></c></row></sheetData></w>')
        z.writestr("xl/worksheets/s2.xml", "<w><sheetData/></w>")
    files = spark.createDataFrame([("f", bytearray(buf.getvalue()))], "doc_id string, content binary")
    rows = sheets.rows_of(files)
    got = sheets.pages(rows).collect()
    assert len(got) == 1
    assert got[0].text == "=== Sheet: One (Part 1/1) ===\n\nhead       |  | c\n-----------|--|--\nlong value |  | 7"
    assert sheets.rows_of(files, ["Two"]).count() == 0


def test_html(spark):
    page = "<head><title>t</title></head><nav>n</nav><h1>A <b>b</b></h1><p>one<p>two <i>x</i><ul><li>p<li>q</ul><table><tr><td>1<td>2</table><pre>c</pre><a href=u>link</a><img src=i>"
    assert html.markdown_of(page) == "# A **b**\n\none\n\ntwo _x_\n\n- p\n- q\n\n1 | 2\n\n```\nc\n```\nlink"
    df = spark.createDataFrame([(1, "pre <h2>T1</h2>a<br>b<h3 class=x>T2</h3>c &amp;lt; d"), (2, "<p>none</p>")], "doc_id int, html string")
    assert [(r.doc_id, r.page_no, r.text) for r in html.section_pages(df).orderBy("doc_id", "page_no").collect()] == [(1, 1, "pre"), (1, 2, "T1a\nb"), (1, 3, "T2c < d"), (2, 1, "none")]


def test_docx(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        p = lambda style, text: f'<p><pPr><pStyle val="{style}"/></pPr><r><t>{text}</t></r></p>'
        z.writestr("word/document.xml", "<document><body>" + p("Heading1", "First") + p("Normal", "a &lt; b") + p("Heading2", "Second") + p("Normal", "c") + "</body></document>")
    got = html.docx_pages(spark.createDataFrame([(1, bytearray(buf.getvalue()))], "doc_id int, content binary")).orderBy("page_no").collect()
    assert [r.text for r in got] == ["Firsta < b", "Secondc"]


def test_pieces_and_chunks(spark):
    assert text_pages.join_pieces([("a", 10), (None, 10), ("b", 10)]) == "a  b"
    assert text_pages.join_pieces([("a", 30), ("b", 28), ("c", 10)], 5) == "ab\nc"
    df = spark.createDataFrame([(1, "aaaa\n\n \n\n" + "b" * 40 + "\n\ncc"), (2, " ")], "doc_id int, text string")
    assert [(r.doc_id, r.text) for r in text_pages.chunk(df, 10).orderBy("doc_id", "page_no").collect()] == [(1, "aaaa"), (1, "b" * 40), (1, "cc"), (2, " ")]
    flat = text_pages.flat_nodes(spark.createDataFrame([(1, 2, "t")], "doc_id int, page_no int, text string"), "csv").first()
    assert (flat.title, flat.node_id, flat.start_index) == ("Rows 11–20", "group_2", 2)


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.trimmed(F.lit("  a b﻿\n"))) == "a b"
    assert one(X.tokens(F.lit("Café -well-known- 2024 _x"))) == ["caf", "well-known", "2024", "_x"]
    assert one(X.pad_start(F.lit("12345"), 4)) == "12345"
    assert one(X.suggested_questions(F.lit("Annual report.pdf")))[0].startswith("What was")
    assert one(X.json_content(F.lit("a ```json\n{}\n``` b ``` c"))) == "{}\n``` b"


def test_farmer_like_search(spark):
    rows = [("d", 0, "p0", "One", 1, 1, "paddy paddy wheat"), ("d", 1, "p1", "Two", 2, 2, "wheat risk risky"), ("d", 2, None, "Three", 3, 3, "barley")]
    nodes = spark.createDataFrame(rows, "doc_id string, node_seq int, node_id string, title string, start_index int, end_index int, text string")
    index = postings.build_keywords(nodes, per_node=30)
    ask = lambda q: [(r.node_id, round(r.total_score, 4), r.matched_term) for r in search.search(index, spark.createDataFrame([(1, q)], "query_id int, query string"), 5).collect()]
    assert ask("the of") == []
    once = ask("paddy")
    assert ask("paddy paddy")[0][1] == pytest.approx(2 * once[0][1], abs=1e-3)
    assert ask("risk")[0][0] == "p1" and ask("risk")[0][1] > once[0][1] * 0.6


def test_markdown_edges(spark):
    text = "lost\n# A\n####### seven\n### Deep\n```\n# x\n```\n  ## indented\n## B\n"
    got = markdown.with_tree(markdown.sections(spark.createDataFrame([(1, text), (2, "none")], "doc_id int, content string"))).orderBy("node_seq").collect()
    assert [(r.title, r.level, r.parent_seq, r.subtree_end) for r in got] == [("A", 1, None, 3), ("Deep", 3, 0, 2), ("B", 2, 0, 3)]
