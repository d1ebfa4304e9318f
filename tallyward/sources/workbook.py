"""Excel workbooks: one row per sheet row, first non-blank row as header. Files are spread over tasks; a file is read by one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: An unpacked workbook may have so many bytes.
MOST_BYTES = 512 << 20
#: Rows of a sheet, by the format.
MOST_ROWS = 1 << 20


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]


def _rows(content: bytes, sheet: int) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("the workbook is too large unpacked")
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{_NS['m']}}}row"):
            # rows that the sheet leaves out are blank ones
            at_row = int(row.get("r", len(out) + 1))
            if at_row > MOST_ROWS:
                raise ValueError("the sheet has too many rows")
            out += [[] for _ in range(at_row - 1 - len(out))]
            cells: dict[int, str] = {}
            for c in row:
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                v = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "")
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text or ""
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def header_names(raw: list[str]) -> list[str]:
    """Merged headers filled forward, repeats numbered."""
    names, seen, last = [], {}, ""
    for x in raw:
        last = x.strip() or last or "COLUMN"
        seen[last] = seen.get(last, 0) + 1
        names.append(last if seen[last] == 1 else f"{last} ({seen[last]})")
    return names


def records(content: bytes, sheet: int = 1) -> Iterator[tuple[int, dict[str, str]]]:
    """(row of the sheet, fields) below the first row that is not blank; blank rows are skipped."""
    rows = [(i, r) for i, r in enumerate(_rows(content, sheet), 1) if any(x.strip() for x in r)]
    if rows:
        names = header_names(rows[0][1])
        for i, r in rows[1:]:
            yield i, dict(zip(names, r + [""] * (len(names) - len(r)), strict=False))


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, line_no, fields) of all workbooks at a path; fields is a map, as sheets may differ."""
    return parse_workbooks(spark.read.format("binaryFile").load(path).select("path", "content"), sheet)


def list_sheets(files: DataFrame) -> DataFrame:
    """(file, sheet) of workbooks (path, content)."""
    names = F.pandas_udf(lambda contents: contents.map(sheet_names), "array<string>")
    return files.select(F.col("path").alias("file"), F.explode(names("content")).alias("sheet"))


def parse_workbooks(files: DataFrame, sheet: int = 1) -> DataFrame:
    """(file, line_no, fields) of workbooks (path, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = list(records(content, sheet))
                yield pd.DataFrame({"file": file, "line_no": [i for i, _ in rows], "fields": [r for _, r in rows]})

    return files.mapInPandas(work, "file string, line_no long, fields map<string,string>").select("file", F.col("line_no"), "fields")
