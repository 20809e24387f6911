"""CSV files as pages of readable text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

DELIMITERS = (",", ";", "\t", "|")


def sniff(text: Column) -> Column:
    """The delimiter most frequent in the first line; of ties the first of DELIMITERS."""
    first = F.element_at(F.split(text, "\n"), 1)
    counts = [F.length(first) - F.length(F.replace(first, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    best = F.lit(DELIMITERS[0])
    for d, n in reversed(list(zip(DELIMITERS, counts, strict=True))):
        best = F.when(n == most, d).otherwise(best)
    return F.when(most > 0, best).otherwise(DELIMITERS[0])


def decode(content: Column) -> Column:
    """UTF-8 bytes as text, without a byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), r"^\x{FEFF}", "")


def parse_text(text: str, delimiter: str) -> list[list[str]]:
    """Rows of trimmed fields. A quote anywhere opens or closes quoting, two inside it are one; blank lines go."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    i, n, quoted, line_start = 0, len(text), False, True
    trim = str.maketrans({"\ufeff": " "})

    def end_field():
        row.append("".join(field).translate(trim).strip() if "\ufeff" in field else "".join(field).strip())
        field.clear()

    while i < n:
        if line_start and not quoted:  # a blank line
            end = text.find("\n", i)
            end = n if end < 0 else end
            if not text[i:end].strip():
                i = end + 1
                continue
            line_start = False
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted:
            end_field()
        elif c == "\n" and not quoted:
            end_field()
            rows.append(row.copy())
            row.clear()
            line_start = True
        else:
            field.append(c)
        i += 1
    if field or row:
        end_field()
        rows.append(row.copy())
    return rows


def parse(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """doc_id, row_no (from 0) and fields of files (doc_id, text). Fields are never typed."""
    if delimiter is not None and len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    given = F.lit(delimiter) if delimiter else sniff(F.col("text"))
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = parse_text(b.column("text")[i].as_py() or "", b.column("delimiter")[i].as_py())
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    ids = pa.array([b.column("doc_id")[i].as_py()] * len(part), b.schema.field("doc_id").type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["doc_id", "row_no", "fields"])

    return files.select("doc_id", "text", given.alias("delimiter")).mapInArrow(run, f"doc_id {kind}, row_no long, fields array<string>")


def pages(rows: DataFrame, rows_per_page: int = 100, header: bool = True, exact_labels: bool = False) -> DataFrame:
    """doc_id, page_no, text, token_count of rows (doc_id, row_no, fields).

    The label counts rows by the page's own length, as readers of such pages expect; on a short last page this gives
    other numbers than the file's, which exact_labels puts right. A file of a header only is one page without label.
    """
    skip = 1 if header else 0
    heads = rows.where("row_no = 0").select("doc_id", F.col("fields").alias("head"))
    body = rows.where(F.col("row_no") >= skip).withColumn("page_no", F.floor((F.col("row_no") - skip) / rows_per_page).cast("int") + 1)
    packed = body.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.array_join("fields", " | ").alias("line")))).alias("xs"))
    total = body.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    full = packed.join(total, "doc_id")
    if header:
        only = heads.join(total, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("page_no"), F.array().cast(packed.schema["xs"].dataType).alias("xs"), F.lit(None).cast("int").alias("n_pages"))
        full = full.unionByName(only).join(heads, "doc_id")
    size = F.greatest(F.size("xs"), F.lit(1))
    first = (F.col("page_no") - 1) * (rows_per_page if exact_labels else size)
    label = F.format_string("[CSV Data — Rows %d–%d of total, Page %d/%d]\n\n", first + 1, first + F.size("xs"), "page_no", "n_pages")
    parts = [F.array_join(F.transform("xs", lambda x: x.line), "\n")]
    if header:
        rule = F.array_join(F.transform("head", lambda h: F.repeat(F.lit("-"), F.greatest(F.length(h), F.lit(3)))), "-|-")
        parts = [F.array_join("head", " | "), rule, F.when(F.size("xs") > 0, parts[0])]
    text = F.concat(F.when(F.col("n_pages").isNotNull(), label).otherwise(""), F.concat_ws("\n", *parts))
    return full.select("doc_id", "page_no", text.alias("text")).withColumn("token_count", X.token_count(F.col("text")))


def read(spark, path: str, delimiter: str | None = None, rows_per_page: int = 100, header: bool = True) -> DataFrame:
    """Pages of the CSV files under a path; doc_id is the file's path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), decode(F.col("content")).alias("text"))
    return pages(parse(files, delimiter), rows_per_page, header)
