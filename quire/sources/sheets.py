"""Spreadsheets as pages of aligned text. Workbooks are read with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

#: Columns are no wider than this; longer cells are not cut.
WIDEST = 40


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def workbook(content: bytes, sheets: list[str] | None = None) -> list[tuple[str, list[list[str]]]]:
    """Sheets in workbook order with their rows of cell texts; blank rows and sheets outside `sheets` are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "content.xml" in z.namelist():
            return _open_document(z, sheets)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(s.tag) != "sheet" or sheets is not None and s.get("name") not in sheets:
                continue
            target = links[next(v for k, v in s.attrib.items() if _local(k) == "id")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows = []
            for r in (x for x in root.iter() if _local(x.tag) == "row"):
                row: list[str] = []
                for c in (x for x in r if _local(x.tag) == "c"):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1 if letters else len(row)
                    row += [""] * (at - len(row))
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    if c.get("t") == "s":
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif c.get("t") == "b":
                        value = "true" if value == "1" else "false"
                    elif value.endswith(".0"):
                        value = value[:-2]
                    row.append(value)
                if any(row):
                    rows.append(row)
            out.append((s.get("name"), rows))
        return out


def _open_document(z: zipfile.ZipFile, sheets: list[str] | None):
    out = []
    for table in (x for x in ElementTree.fromstring(z.read("content.xml")).iter() if _local(x.tag) == "table"):
        name = next((v for k, v in table.attrib.items() if _local(k) == "name"), "")
        if sheets is not None and name not in sheets:
            continue
        rows = []
        for r in (x for x in table.iter() if _local(x.tag) == "table-row"):
            row: list[str] = []
            for c in (x for x in r if _local(x.tag) in ("table-cell", "covered-table-cell")):
                times = next((int(v) for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), 1)
                text = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
                row += [text] * (times if text else min(times, 64))
            while row and not row[-1]:
                row.pop()
            if row:
                rows.append(row)
        out.append((name, rows))
    return out


def rows_of(files: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """doc_id, sheet_no, sheet, row_no (from 0, the header) and cells of files (doc_id, content)."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, (name, rows) in enumerate(workbook(b.column("content")[i].as_py(), sheets)):
                    for at in range(0, len(rows), 10_000):
                        part = rows[at : at + 10_000]
                        ids = pa.array([b.column("doc_id")[i].as_py()] * len(part), b.schema.field("doc_id").type)
                        cols = [ids, pa.array([k] * len(part), pa.int32()), pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sheet_no", "sheet", "row_no", "cells"])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, sheet_no int, sheet string, row_no long, cells array<string>")


def pages(rows: DataFrame, rows_per_chunk: int = 200) -> DataFrame:
    """doc_id, sheet_no, part_no, text, token_count: chunks of rows under the sheet's header, in aligned columns."""
    key = ["doc_id", "sheet_no", "sheet"]
    heads = rows.where("row_no = 0").select(*key, F.col("cells").alias("head"))
    body = rows.where("row_no > 0").withColumn("part_no", F.floor((F.col("row_no") - 1) / rows_per_chunk).cast("int") + 1)
    packed = body.groupBy(*key, "part_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("xs"))
    total = body.groupBy(*key).agg(F.max("part_no").alias("n_parts"))
    full = heads.join(total, key, "left").join(packed, key, "left")
    full = full.select(*key, "head", F.coalesce("n_parts", F.lit(1)).alias("n_parts"), F.coalesce("part_no", F.lit(1)).alias("part_no"), F.coalesce("xs", F.array().cast(packed.schema["xs"].dataType)).alias("xs"))
    cell = lambda cells, i: F.coalesce(F.get(cells, i), F.lit(""))
    width = F.transform("head", lambda h, i: F.least(F.lit(WIDEST), F.greatest(F.length(h), F.coalesce(F.array_max(F.transform("xs", lambda x: F.length(cell(x.cells, i)))), F.lit(0)))))
    full = full.withColumn("w", width)
    aligned = lambda of: F.array_join(F.transform("w", lambda w, i: X.pad_end(of(i), w)), " | ")
    lines = F.transform("xs", lambda x: aligned(lambda i: cell(x.cells, i)))
    label = F.format_string("=== Sheet: %s (Part %d/%d) ===", "sheet", "part_no", "n_parts")
    rule = F.array_join(F.transform("w", lambda w: F.repeat(F.lit("-"), w)), "-|-")
    text = F.array_join(F.concat(F.array(label, F.lit(""), aligned(lambda i: cell(F.col("head"), i)), rule), lines), "\n")
    return full.select("doc_id", "sheet_no", "part_no", text.alias("text")).withColumn("token_count", X.token_count(F.col("text")))
