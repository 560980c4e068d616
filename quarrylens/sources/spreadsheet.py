"""Reading of .xlsx workbooks (a ZIP of XML parts) as a Python data source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 22, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts; cells styled as dates are ISO days."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in parts else []
        dated: set[int] = set()
        if "xl/styles.xml" in parts:
            styles = tree("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            formats = styles.find(f"{_NS}cellXfs")
            for i, x in enumerate(formats if formats is not None else []):
                k = int(x.get("numFmtId", 0))
                if k in _DATE_FORMATS or re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I):
                    dated.add(i)
        sheet = tree("xl/workbook.xml").find(f"{_NS}sheets")[0].get(_REL)
        target = next(r.get("Target") for r in tree("xl/_rels/workbook.xml.rels") if r.get("Id") == sheet)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in tree(path).iter(f"{_NS}row"):
            out: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                out += [None] * (at + 1 - len(out))
                kind, v = c.get("t"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                elif kind in (None, "n") and int(c.get("s", 0)) in dated:
                    value = (datetime(1899, 12, 30) + timedelta(days=float(v.text))).strftime("%Y-%m-%d")
                else:
                    value = v.text
                out[at] = value.strip() or None if value is not None else None
            yield out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``_row_id`` and a text column for each header cell of the first sheet; empty rows are left out.

    A workbook is one file, so it is parsed by one task; many workbooks of the
    same header are parsed in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.orderBy("path").limit(1).select("content").first()
    if head is None:
        raise ValueError(f"no workbook at {path}")
    header = next(sheet_rows(bytes(head[0])), [])
    while header and header[-1] is None:
        header.pop()
    if not header or None in header or len(set(header)) != len(header):
        raise ValueError(f"the first row is no header of distinct names: {header}")
    width = len(header)

    @F.udf("array<array<string>>")
    def rows_of(content: bytes) -> list[list[str | None]]:
        rows = list(sheet_rows(bytes(content)))[1:]
        return [(r + [None] * width)[:width] for r in rows]

    cells = files.select("path", F.posexplode(rows_of("content")).alias("_row_id", "cells")).where(F.exists("cells", lambda x: x.isNotNull()))
    return cells.select(F.col("_row_id").cast("long").alias("_row_id"), *[F.col("cells")[i].alias(h) for i, h in enumerate(header)])
