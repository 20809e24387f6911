"""Plain texts and ready pages: chunking, flat indexes, and PDF pages where a reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X


def chunk(docs: DataFrame, tokens_per_page: int = 600, text: str = "text") -> DataFrame:
    """doc_id, page_no, text, token_count: paragraphs packed in order until one more would exceed a page.

    A fold over a document's paragraphs in its own row; separators aren't counted; a text without paragraphs is a page.
    """
    paras = F.filter(F.split(text, r"\n\n+"), lambda p: X.trimmed(p) != "")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(a, p):
        t = F.ceil(F.length(p) / 4).cast("int")
        full = (a.n + t > tokens_per_page) & (F.size(a.now) > 0)
        return F.struct(
            F.when(full, F.concat(a.done, F.array(a.now))).otherwise(a.done).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(a.now, F.array(p))).alias("now"),
            F.when(full, t).otherwise(a.n + t).alias("n"),
        )

    packed = F.aggregate(paras, start, step, lambda a: F.when(F.size(a.now) > 0, F.concat(a.done, F.array(a.now))).otherwise(F.array(F.array(F.col(text)))))
    pages = docs.select("doc_id", F.posexplode(packed).alias("at", "ps"))
    return pages.select("doc_id", (F.col("at") + 1).alias("page_no"), F.array_join("ps", "\n\n").alias("text")).withColumn("token_count", X.token_count(F.col("text")))


def flat_nodes(pages: DataFrame, kind: str = "text", rows_per_page: int = 10) -> DataFrame:
    """One node for each page. kind: csv (rows a-b), pdf (pages) or text (sections). All ranges count from 1."""
    no = F.col("page_no")
    title, node_id = {
        "csv": (F.format_string("Rows %d–%d", (no - 1) * rows_per_page + 1, no * rows_per_page), F.format_string("group_%d", no)),
        "pdf": (F.format_string("Page %d", no), F.format_string("page_%d", no)),
        "text": (F.format_string("Section %d", no), F.format_string("sec_%d", no)),
    }[kind]
    return pages.select("doc_id", (no - 1).alias("node_seq"), node_id.alias("node_id"), title.alias("title"), no.alias("start_index"), no.alias("end_index"), "text")


def pdf_pages(files: DataFrame, newline_gap: float | None = None) -> DataFrame:
    """doc_id, page_no, text, token_count of PDF files (doc_id, content); needs the optional package pypdf.

    Text pieces are joined by blanks; with newline_gap, a piece lower or higher by more starts a new line instead.
    """
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pypdf import PdfReader

        for b in batches:
            for i in range(b.num_rows):
                ids, nos, texts = [], [], []
                for no, page in enumerate(PdfReader(io.BytesIO(b.column("content")[i].as_py())).pages, 1):
                    pieces: list[tuple[str, float]] = []
                    page.extract_text(visitor_text=lambda t, cm, tm, *_: pieces.append((t, tm[5])))  # noqa: B023
                    ids.append(b.column("doc_id")[i].as_py()), nos.append(no), texts.append(join_pieces(pieces, newline_gap))
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "page_no", "text"])

    found = files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, page_no int, text string")
    return found.withColumn("token_count", X.token_count(F.col("text")))


def join_pieces(pieces: list[tuple[str | None, float]], newline_gap: float | None = None) -> str:
    """Text pieces with their heights on the page as one text; a piece that is no text counts as empty."""
    if newline_gap is None:
        return " ".join(t or "" for t, _ in pieces)
    out, last = "", None
    for t, y in pieces:
        if last is not None and abs(y - last) > newline_gap:
            out += "\n"
        out, last = out + (t or ""), y
    return out.strip()
