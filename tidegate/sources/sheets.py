"""Spreadsheets (.xlsx) as lines of CSV, so that whatever reads a CSV record reads a sheet.

Spark reads the files, so any store it reaches will do; a sheet holds 1,048,576 rows at most, which bounds the task that takes one apart. Its XML is
read as a stream and leaves in Arrow batches; no sheet is held whole.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 2048
#: The numbers of the built-in formats of dates and times, the first day of serial dates.
DATES = {*range(14, 23), *range(45, 48)}
FIRST_DAY = datetime(1899, 12, 30)
LINES = "row_id long, value string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells share; runs of differently written letters are joined, phonetic ones left out."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if _local(e.tag) == "si":
                out.append(_said(e))
                e.clear()
    return out


def _said(e: ET.Element) -> str:
    return "".join(t.text or "" for part in e if _local(part.tag) != "rPh" for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """For each style of a cell whether it shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {e.get("numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in root.iter() if _local(e.tag) == "numFmt"}
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    return [int(x.get("numFmtId", 0)) in DATES or bool(re.search("[ymdhs]", own.get(x.get("numFmtId"), ""), re.I)) for x in formats]


def _moment(serial: float) -> str:
    """A serial date as text: a date, a time, or both."""
    at = FIRST_DAY + timedelta(seconds=round(serial * 86_400))
    if serial < 1:
        return f"{at:%H:%M:%S}"
    return f"{at:%Y-%m-%d}" if float(serial).is_integer() else f"{at:%Y-%m-%d %H:%M:%S}"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet."""
    links = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheet = next(e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet")
    target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """Number (from 1) and cells of each row of the first sheet; rows and cells that are left out of the file are empty."""
    book = zipfile.ZipFile(io.BytesIO(content))
    texts, dated = _texts(book), _dated(book)
    last = 0
    with book.open(_first_sheet(book)) as f:
        for _, row in ET.iterparse(f):
            if _local(row.tag) != "row":
                continue
            at = int(row.get("r", last + 1))
            yield from ((i, []) for i in range(last + 1, at))
            cells: list[str] = []
            for c in row:
                place = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (place + 1 - len(cells))
                cells[place] = _value(c, texts, dated)
            yield at, cells
            last = at
            row.clear()


def _value(c: ET.Element, texts: list[str], dated: list[bool]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return next((_said(e) for e in c if _local(e.tag) == "is"), "")
    v = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
    if kind == "s" and v:
        return texts[int(v)]
    if kind == "n" and v and int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
        return _moment(float(v))
    return v


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            numbers, values = [], []
            for n, cells in rows(content.as_py()):
                line = io.StringIO()
                csv.writer(line, lineterminator="").writerow(cells)
                numbers.append(n)
                values.append(line.getvalue().replace("\n", " ") if any(cells) else "")
                if len(numbers) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(values)], ["row_id", "value"])
                    numbers, values = [], []
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.string())], ["row_id", "value"])


def is_sheet(path: str) -> bool:
    return path.lower().endswith(".xlsx")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id (the sheet's own numbers) and value (the row as a line of CSV) of a workbook's first sheet. Dates and times are ISO text."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_run, LINES)
