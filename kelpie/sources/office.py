"""Readers of office files: cells of XLSX sheets and paragraphs of DOCX texts as rows, file by file inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = "path string, sheet string, row int, cells array<string>"
PARAGRAPHS = "path string, position int, text string"
BATCH = 1000


def _column(ref: str) -> int:
    """The number of a cell's column, from 0: A1 is 0, AB7 is 27."""
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook; missing cells are null. Dates are left as the numbers that they are."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            with z.open(name) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_S}row":
                        continue
                    cells: list[str | None] = []
                    for k, c in enumerate(row.iter(f"{_S}c")):
                        at = _column(c.get("r")) if c.get("r") else k
                        cells += [None] * (at + 1 - len(cells))
                        value, kind = c.find(f"{_S}v"), c.get("t")
                        if kind == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if kind == "s" else value.text
                    yield name.rsplit("/", 1)[1][:-4], int(row.get("r") or 0), cells
                    row.clear()


def paragraphs(data: bytes) -> Iterator[str]:
    """The paragraphs of a document that hold text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
            text = "".join((t.text or "") if t.tag == f"{_W}t" else "\t" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
            if text.strip():
                yield text


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """ROWS of all sheets of the files; a broken file fails the job. A folder without files gives no rows."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for sheet, row, cells in sheet_rows(data):
                    held.append((name, sheet, row, cells))
                    if len(held) == BATCH:
                        yield _batch(held, [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())], ["path", "sheet", "row", "cells"])
                        held = []
                yield _batch(held, [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())], ["path", "sheet", "row", "cells"])

    return _files(spark, path, glob).mapInArrow(run, ROWS)


def documents(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """PARAGRAPHS of the files, in order."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _batch([(name, k, t) for k, t in enumerate(paragraphs(data))], [pa.string(), pa.int32(), pa.string()], ["path", "position", "text"])

    return _files(spark, path, glob).mapInArrow(run, PARAGRAPHS)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)
