"""Workbook uploads (S2): first sheet of each .xlsx, raw cell values, blanks as ''.

A workbook is a zip archive and cannot be split, so each file is one task
(``binaryFile`` + ``mapInPandas``); files are spread over the cluster. Rows come
out long-form — (upload_id, row_ord, cells map) with map keys already normalised
(lower-case, whitespace removed, leftmost header wins) — because headers differ
per file. Numbers keep their raw form ('45992', '0.385417'), so serial dates stay
serials. Legacy binary .xls is not read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from punchspark.policy import TIME_ALIASES
from punchspark.sources.aliases import header_key

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

TIME_KEYS = frozenset(header_key(a) for a in TIME_ALIASES)

ROW_SCHEMA = T.StructType(
    [
        T.StructField("upload_id", T.StringType()),
        T.StructField("row_ord", T.StructType([T.StructField("blk", T.LongType()), T.StructField("rec", T.LongType())])),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _number_text(v: str) -> str:
    """Raw numeric cell → JS String(number) form."""
    try:
        x = float(v)
    except ValueError:
        return v
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    return repr(x)


class Falsy(str):
    """Text of a numeric 0 or a false: as good as blank, except as a time of day."""


def _first_sheet_rows(data: bytes) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", NS)
        rid = first.get(f"{{{REL_NS}}}id")
        target = "xl/worksheets/sheet1.xml"
        if "xl/_rels/workbook.xml.rels" in names:
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels:
                if rel.get("Id") == rid:
                    t = rel.get("Target").lstrip("/")
                    target = t if t.startswith("xl/") else f"xl/{t}"
        sheet = ET.fromstring(z.read(target))
    rows: list[list[str]] = []
    for row in sheet.iter(f"{{{NS['m']}}}row"):
        vals: dict[int, str] = {}
        at = -1
        for c in row.findall("m:c", NS):
            at = _col_index(c.get("r")) if c.get("r") else at + 1  # the reference is optional
            kind = c.get("t", "n")
            v = c.find("m:v", NS)
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif v is None:
                continue
            elif kind == "s":
                text = shared[int(v.text)]
            elif kind == "b":
                text = "true" if v.text == "1" else Falsy("false")
            elif kind in ("str", "e"):
                text = v.text or ""
            else:
                text = _number_text(v.text or "")
                text = Falsy(text) if text == "0" else text
            vals[at] = text
        if vals:
            width = max(vals) + 1
            rows.append([vals.get(i, "") for i in range(width)])
    return rows


def _cell(key: str, value: str) -> str:
    return "" if isinstance(value, Falsy) and key not in TIME_KEYS else str(value)


def _explode_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame per workbook, so that a batch of files never stands in memory as rows."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            out_id, out_ord, out_cells = [], [], []
            rows = _first_sheet_rows(bytes(content))
            if not rows:
                continue
            header = rows[0]
            keys: dict[int, str] = {}
            seen: set[str] = set()
            for i, h in enumerate(header):
                k = header_key(str(h))
                if h != "" and k not in seen:
                    seen.add(k)
                    keys[i] = k
            for n, r in enumerate(rows[1:], start=1):
                if all(x == "" for x in r):
                    continue
                cells = {k: _cell(k, r[i]) if i < len(r) else "" for i, k in keys.items()}
                out_id.append(path)
                out_ord.append({"blk": 0, "rec": n})
                out_cells.append(cells)
            yield pd.DataFrame({"upload_id": out_id, "row_ord": out_ord, "cells": out_cells})


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Long rows (upload_id, row_ord, cells) from the first sheet of every .xlsx."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(paths).select("path", "content")
    return files.mapInPandas(_explode_workbooks, ROW_SCHEMA)


def write_xlsx(path: str, header: list[str], rows: list[list]) -> None:
    """Minimal single-sheet .xlsx writer (numbers as numeric cells) for fixtures."""

    def col(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    def cell(ref: str, v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        text = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'

    body = []
    for ri, r in enumerate([header, *rows], start=1):
        body.append(f'<row r="{ri}">' + "".join(cell(f"{col(ci)}{ri}", v) for ci, v in enumerate(r) if v != "") + "</row>")
    sheet = (
        '<?xml version="1.0" encoding="UTF-8"?>'
        f'<worksheet xmlns="{NS["m"]}"><sheetData>{"".join(body)}</sheetData></worksheet>'
    )
    workbook = (
        '<?xml version="1.0" encoding="UTF-8"?>'
        f'<workbook xmlns="{NS["m"]}" xmlns:r="{REL_NS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    )
    rels = (
        '<?xml version="1.0" encoding="UTF-8"?>'
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
        'Target="worksheets/sheet1.xml"/></Relationships>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", workbook)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
