"""Spreadsheets as records."""

from __future__ import annotations

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from tidegate.sources import plants, records, sheets


def letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, rows):
    """A small .xlsx: text as shared or inline strings, dates as numbers with a style, None as no cell, an empty row as no row."""
    shared, body = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            at = f"{letters(i)}{n}"
            if v is None:
                continue
            if isinstance(v, datetime):
                serial = (v - datetime(1899, 12, 30)).total_seconds() / 86_400
                cells.append(f'<c r="{at}" s="1"><v>{serial!r}</v></c>')
            elif isinstance(v, str) and i % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        if cells:
            body.append(f'<row r="{n}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy\\ hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")


def test_cells(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    workbook(path, [["one, two", 'a "b"', 1.5], [], [None, None, datetime(2017, 10, 9), datetime(2017, 10, 9, 18, 0, 1)], [*([None] * 27), 7]])
    got = {r.row_id: r.value for r in sheets.lines(spark, path).collect()}
    assert got == {1: '"one, two","a ""b""",1.5', 2: "", 3: ",,2017-10-09,2017-10-09 18:00:01", 4: "," * 27 + "7"}


def test_a_record_in_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "ROWS", 16)
    title = [["a title"], [" Timestamp", "FIT101 ", "Normal/Attack"]]
    line = lambda i, label: [datetime(2015, 12, 28, 10, 0, i % 60), i, label]
    workbook(tmp_path / "Plant_Dataset_Normal_v1.xlsx", title + [line(i, "Normal") for i in range(40)])
    workbook(tmp_path / "Plant_Dataset_Attack_v0.xlsx", title + [line(i, "A ttack" if i > 30 else "Normal") for i in range(40)])
    normal, attack = records.load(spark, str(tmp_path), "inline", skip=10, step=5)
    assert [(r.FIT101, r.datetime.second) for r in normal.orderBy("row_id").collect()] == [(float(i), i) for i in range(10, 40, 5)]
    assert attack.count() == 8 and attack.filter("att_flag = 1").count() == 1


def test_an_interval_sheet(spark, tmp_path):
    workbook(tmp_path / "attack_description.xlsx", [["Attacks"], [], ["S.No", "Date", "Start Time", "End Time"], [1, datetime(2017, 10, 9), "18:00.01", "18:00:03"], [2, None, "18:00:04", "18:00:05"]])
    preamble = "info\nRow,Date,Time,\\\\S\\1_FIT_001_PV,\\\\S\\1_P_001_STATUS\n"
    for n in ("W_14days.csv", "W_attackdata.csv"):
        (tmp_path / n).write_text(preamble + "".join(f"{i + 1},10/9/2017,6:00:0{i}.000 PM,{i},1\n" for i in range(6)))
    sheet = plants.read_sheet(spark, str(tmp_path / "attack_description.xlsx")).orderBy("position").collect()
    assert [(r.date, r.start_time) for r in sheet] == [("2017-10-09", "18:00.01"), (None, "18:00:04")] or sheet[1].date == ""
    _, attack = records.load(spark, str(tmp_path), "logged")
    assert [r.att_flag for r in attack.orderBy("row_id").collect()] == [0, 1, 1, 0, 1, 0]


def test_missing_parts_are_named(spark, tmp_path):
    (tmp_path / "Dataset_Normal.csv").write_text("Timestamp,FIT101,Normal/Attack\n28/12/2015 10:00:00 AM,1,Normal\n")
    (tmp_path / "Dataset_Attack.xls").write_bytes(b"old")
    with pytest.raises(FileNotFoundError, match="no attack part.*dataset_attack.xls"):
        records.load(spark, str(tmp_path), "inline")
