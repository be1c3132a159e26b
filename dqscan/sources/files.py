"""Tables from CSV, TSV, XLSX and Parquet files, as frames of text cells with a row number."""

from __future__ import annotations

import csv
import glob
import io
import os
import re
import zipfile
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqscan.functions.text import na_to_null
from dqscan.operators.columns import MARK, OWN, ROW, as_text, is_numbered, with_row_idx

SUPPORTED_EXTENSIONS = (".xlsx", ".csv", ".tsv", ".parquet")
#: Known, but not read: the binary workbooks of old.
UNREADABLE = (".xls",)


def resolve_inputs(arg: str) -> list[str]:
    """A file, all supported files under a folder, or those a pattern finds."""
    good = lambda p: Path(p).suffix.lower() in SUPPORTED_EXTENSIONS
    if os.path.isfile(arg):
        return [arg] if good(arg) else []
    if os.path.isdir(arg):
        return sorted(str(p) for p in Path(arg).rglob("*") if p.is_file() and good(p))
    return sorted(p for p in glob.glob(arg, recursive=True) if os.path.isfile(p) and good(p))


def skipped_inputs(arg: str) -> list[str]:
    """Workbooks under a folder or pattern that can't be read, for a warning."""
    found = Path(arg).rglob("*") if os.path.isdir(arg) else map(Path, glob.glob(arg, recursive=True))
    return sorted(str(p) for p in found if p.suffix.lower() in UNREADABLE and p.is_file())


def unique_names(names: list[str]) -> list[str]:
    """Repeated headers become A, A.1, A.2."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"Unnamed: {i}"
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{seen[n]}" if seen[n] else n)
    return out


def _nulled(df: DataFrame) -> DataFrame:
    own = is_numbered(df)
    return df.select(*[F.col(ROW) if own and c == ROW else na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The names of the first record, which may hold line ends between quotes; as many lines are read as it has."""
    text, lines = "", 1
    while True:
        got = [r[0] for r in spark.read.text(path).limit(lines).collect()]
        text = "\n".join(got).lstrip("\ufeff")
        if text.count('"') % 2 == 0 or len(got) < lines:
            return unique_names(next(csv.reader(io.StringIO(text), delimiter=sep), [])) if got else []
        lines *= 2 if lines > 1 else 8


def _one_line_records(spark: SparkSession, path: str) -> bool:
    """Whether every line has an even number of quotes, so that no record goes on in the next one and the file can be split."""
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    return not spark.read.text(path).where(odd).limit(1).count()


def delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Quoted fields may hold separators, doubled quotes and line ends. A file without line ends in fields is read in splits."""
    names = _header(spark, path, sep)
    if not names:
        return spark.createDataFrame([], T.StructType())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"header": True, "sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "enforceSchema": True, "nullValue": "", "emptyValue": ""}
    df = spark.read.schema(schema).options(**options, multiLine=not _one_line_records(spark, path)).csv(path)
    return with_row_idx(_nulled(df))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


#: Numbers of the built-in formats that show dates or times (fixed values).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iterfind(".//m:numFmts/m:numFmt", _NS)}
    shows = lambda k: k in DATE_FORMATS if k not in own else bool(re.search("[dmyhs]", own[k], re.IGNORECASE)) and own[k].lower() != "general"
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if shows(int(x.get("numFmtId", 0)))}


def _number(text: str, dated: bool, first: datetime) -> str:
    """A numeric cell as text: whole numbers without a point, dates as `yyyy-mm-dd hh:mm:ss`, times of day alone as such."""
    x = float(text)
    if dated:
        at = first + timedelta(microseconds=round(x * 86_400_000) * 1000)
        return str(at.time()) if 0 <= x < 1 else str(at)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def xlsx_rows(path: str) -> dict[str, list[list[str | None]]]:
    """The cells of every sheet as text. Workbooks are bounded by their format, so that the driver can read them."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{_NS['m']}}}t"))
        shared = [text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book, dated, out = ElementTree.fromstring(z.read("xl/workbook.xml")), _date_styles(z), {}
        since = book.find("m:workbookPr", _NS)
        first = datetime(1904, 1, 1) if since is not None and since.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in book.find("m:sheets", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = text(c)
                    elif value is not None and value.text is not None:
                        match kind:
                            case "s":
                                cells[at] = shared[int(value.text)]
                            case "b":
                                cells[at] = {"1": "True", "0": "False"}.get(value.text, value.text)
                            case None | "n":
                                cells[at] = _number(value.text, int(c.get("s", 0)) in dated, first)
                            case _:
                                cells[at] = value.text
                rows.append(cells)
            out[sheet.get("name")] = rows
        return out


def load_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{sheet name: frame}; one sheet, named after the file, for all but workbooks."""
    ext, stem = Path(path).suffix.lower(), Path(path).stem
    if ext in (".csv", ".tsv"):
        return {stem: delimited(spark, path, "\t" if ext == ".tsv" else ",")}
    if ext == ".parquet":
        return {stem: with_row_idx(as_text(spark.read.parquet(path)))}
    if ext == ".xlsx":
        out = {}
        for name, rows in xlsx_rows(path).items():
            if not rows:
                continue
            width = max(map(len, rows))
            pad = lambda r, width=width: r + [None] * (width - len(r))
            names = unique_names([h or "" for h in pad(rows[0])])
            names = [OWN if n == ROW else n for n in names]
            schema = T.StructType([T.StructField(ROW, T.LongType(), True, MARK), *(T.StructField(n, T.StringType()) for n in names)])
            out[name] = _nulled(spark.createDataFrame([(i, *pad(r)) for i, r in enumerate(rows[1:])], schema))
        return out
    raise ValueError(f"can't read {ext or 'a file without extension'}; known are {', '.join(SUPPORTED_EXTENSIONS)}" + ("; save .xls workbooks as .xlsx" if ext == ".xls" else ""))
