"""HTML and Word texts: sections by headings, plain text, and Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as X

#: Entities in the order in which they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"))
#: Elements whose content is no text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")


def strip_tags(html: Column) -> Column:
    """Plain text: some tags end lines, all others go, entities are decoded once in order, blank lines collapse."""
    c = html
    for tag in (r"<br\s*/?>", "</p>", "</li>"):
        c = F.regexp_replace(c, f"(?i){tag}", "\n")
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return X.trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


_HEADING = r"(?is)<(h[1-6])[^>]*>.*?</\1>"


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no (from 1) and text of docs (doc_id, html): each heading up to the next; text before is first.

    Documents without a heading give no rows.
    """
    mark = "\x00"
    marked = F.regexp_replace("html", rf"(?is)(<(h[1-6])[^>]*>.*?</\2>)", mark + "$1")
    parts = docs.where(F.col("html").rlike(_HEADING)).select("doc_id", F.posexplode(F.split(marked, mark)).alias("at", "part"))
    texts = parts.select("doc_id", "at", strip_tags(F.col("part")).alias("text")).where("at > 0 or text <> ''")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return texts.select("doc_id", number.alias("section_no"), "text")


def section_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, text, token_count; a document without headings is one page of all its text."""
    found = sections(docs).withColumnRenamed("section_no", "page_no")
    whole = docs.where(~F.col("html").rlike(_HEADING)).select("doc_id", F.lit(1).alias("page_no"), strip_tags(F.col("html")).alias("text"))
    return found.unionByName(whole).withColumn("token_count", X.token_count(F.col("text")))


class _Element:
    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, tags: tuple[str, ...]) -> list[_Element]:
        out = []
        for c in self.children:
            if not isinstance(c, str):
                out += [c] * (c.tag in tags) + c.find(tags)
        return out


class _Builder(HTMLParser):
    """A tree of elements, with the implied ends of paragraphs and list items that common pages leave out."""

    VOID = ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr")
    BLOCKS = ("p", "div", "ul", "ol", "li", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "article", "section", "nav", "footer", "header", "aside")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("html")
        self.open = [self.root]

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self._close("p", ("table", "td"))
        if tag == "li":
            self._close("li", ("ul", "ol"))
        if tag in ("td", "th"):
            self._close("td", ("tr",)), self._close("th", ("tr",))
        if tag == "tr":
            self._close("tr", ("table",))
        new = _Element(tag)
        self.open[-1].children.append(new)
        if tag not in self.VOID:
            self.open.append(new)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


_WRAP = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`"}


def _markdown(node) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in (*DROPPED, "img", "head"):
        return ""
    if node.tag == "table":
        rows = (" | ".join(c.text().strip() for c in r.find(("td", "th"))) for r in node.find(("tr",)))
        return "\n" + "\n".join(r for r in rows if r) + "\n"
    inner = "".join(map(_markdown, node.children))
    if m := re.fullmatch("h([1-6])", node.tag):
        return "\n" + "#" * int(m[1]) + f" {inner.strip()}\n"
    if node.tag in _WRAP:
        return _WRAP[node.tag] + inner + _WRAP[node.tag]
    plain = {"p": "\n{}\n", "li": "\n- {}", "pre": "\n```\n{}\n```\n", "blockquote": "\n> {}\n"}
    if node.tag in plain:
        return plain[node.tag].format(inner.strip())
    return {"br": "\n", "hr": "\n---\n", "ul": f"\n{inner}\n", "ol": f"\n{inner}\n"}.get(node.tag, inner)


def markdown_of(html: str | None) -> str:
    if html is None:
        return ""
    b = _Builder()
    b.feed(html)
    b.close()
    return re.sub(r"\n{3,}", "\n\n", _markdown(b.root)).strip()


@F.pandas_udf(StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    """Markdown of pages: headings, lists, emphasis, code, quotes, rules and tables; links keep their text only."""
    return html.map(markdown_of)


def docx_html(content: bytes) -> str:
    """A Word file's paragraphs as HTML: heading styles as h1-h6, list items, tables' cells, bold and italics."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for p in (e for e in root.iter() if local(e) == "p"):
        style, item, text = "", False, ""
        for e in p.iter():
            if local(e) == "pStyle":
                style = next(iter(e.attrib.values()), "")
            elif local(e) == "numPr":
                item = True
            elif local(e) == "t":
                text += (e.text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            elif local(e) == "br":
                text += "<br />"
            elif local(e) == "tab":
                text += "\t"
        level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
        tag = f"h{level[1]}" if level else "li" if item else "p"
        if text:
            out.append(f"<{tag}>{text}</{tag}>")
    return "".join(out)


def docx_pages(files: DataFrame) -> DataFrame:
    """doc_id, page_no, text, token_count of Word files (doc_id, content), one page for each heading's section."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [docx_html(c) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(html, pa.string())], names=["doc_id", "html"])

    return section_pages(files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, html string"))
