"""Text and cells of office files: jobs over binaryFile, one row of error for a file that can't be read."""

from __future__ import annotations

import datetime
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_LIMIT, FILE_LIMIT = 32 << 20, 64 << 20
#: Numbers of built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
TEXT = "path string, text string, error string"
CELLS = "path string, sheet string, row int, col int, type string, text string, num double, error string"


class _Package:
    """Parts of a zip file, within limits of what they inflate to."""

    def __init__(self, content: bytes):
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(content)), FILE_LIMIT

    def names(self, pattern: str) -> list[str]:
        number = lambda s: [(int(p) if p.isdigit() else p) for p in re.findall(r"\d+|\D+", s)]
        return sorted((n for n in self.zip.namelist() if re.fullmatch(pattern, n)), key=number)

    def xml(self, name: str):
        from xml.etree import ElementTree

        with self.zip.open(name) as part:
            data = part.read(min(PART_LIMIT, self.left) + 1)
        if len(data) > min(PART_LIMIT, self.left):
            raise ValueError(f"{name} inflates beyond the limit")
        self.left -= len(data)
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise ValueError(f"{name} has a document type")
        return ElementTree.fromstring(data)


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _paragraphs(root, paragraph: set[str], run: set[str]) -> str:
    out = []

    def walk(e):
        name = _local(e)
        if name in run and e.text:
            out.append(e.text)
        if name in ("tab",):
            out.append("\t")
        if name in ("br", "line-break"):
            out.append("\n")
        for child in e:
            walk(child)
            if child.tail and "*" in run:
                out.append(child.tail)
        if name in paragraph:
            out.append("\n")

    walk(root)
    return "".join(out)


def office_text(path: str, content: bytes) -> str:
    """The text of a docx, pptx, xlsx, odt, ods or odp file, runs of blank lines made one."""
    package, kind = _Package(content), path.rpartition(".")[2].lower()
    if kind == "docx":
        text = _paragraphs(package.xml("word/document.xml"), {"p"}, {"t"})
    elif kind == "pptx":
        text = "\n".join(_paragraphs(package.xml(n), {"p"}, {"t"}) for n in package.names(r"ppt/slides/slide\d+\.xml"))
    elif kind == "xlsx":
        text = "\n".join(_paragraphs(package.xml(n), {"si"}, {"t"}) for n in package.names(r"xl/sharedStrings\.xml"))
    elif kind in ("odt", "ods", "odp"):
        text = _paragraphs(package.xml("content.xml"), {"p", "h"}, {"p", "h", "span", "a", "*"})
    else:
        raise ValueError(f"no extractor for .{kind}")
    return re.sub(r"\n\s*\n+", "\n\n", text).strip()


def extract_office_text(files: DataFrame) -> DataFrame:
    """TEXT of files(path, content), as binaryFile reads them."""

    def read(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, office_text(path, bytes(content)), None))
                except Exception as error:  # whatever a damaged file raises is its row's error
                    rows.append((path, None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, TEXT)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shows_date(code: str) -> bool:
    """Whether a number format has a part of a date or time outside quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code.split(";")[0])
    return bool(re.search(r"[dmyhs]", plain, re.IGNORECASE)) and not re.search(r"[0#?]", re.sub(r"s\.0+", "s", plain))


def _date_styles(package: _Package) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if not package.names(r"xl/styles\.xml"):
        return set()
    root = package.xml("xl/styles.xml")
    own = {int(e.get("numFmtId", -1)): e.get("formatCode", "") for e in root.iter() if _local(e) == "numFmt"}
    formats = [int(e.get("numFmtId", 0)) for part in root if _local(part) == "cellXfs" for e in part]
    return {k for k, n in enumerate(formats) if (_shows_date(own[n]) if n in own else n in DATE_FORMATS)}


def _system(package: _Package) -> int:
    """1904 where the workbook counts days from there."""
    for name in package.names(r"xl/workbook\.xml"):
        for e in package.xml(name).iter():
            if _local(e) == "workbookPr" and e.get("date1904") in ("1", "true"):
                return 1904
    return 1900


def serial_text(serial: float, system: int = 1900) -> str | None:
    """Date, date and time, or time of day of a day number, as ISO text; None for day 60 of the 1900 system, which never
    was, and for days before the first."""
    seconds = round(serial * 86_400)
    day, clock = divmod(seconds, 86_400)
    if day < 0 or (system == 1900 and day == 60):
        return None
    start = datetime.date(1904, 1, 1) if system == 1904 else datetime.date(1899, 12, 31 if day < 60 else 30)
    time = f"{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d}"
    if not day and clock and system == 1900:
        return time
    try:
        date = (start + datetime.timedelta(days=day)).isoformat()
    except OverflowError:
        return None
    return f"{date} {time}" if clock else date


def _xlsx_cells(package: _Package, max_rows: int, max_cols: int):
    strings = [_paragraphs(si, set(), {"t"}) for n in package.names(r"xl/sharedStrings\.xml") for si in package.xml(n)]
    dates, system = _date_styles(package), _system(package)
    for name in package.names(r"xl/worksheets/sheet\d+\.xml"):
        sheet, row = name.rpartition("/")[2].removesuffix(".xml"), -1
        for r in (e for e in package.xml(name).iter() if _local(e) == "row"):
            row = int(r.get("r", row + 2)) - 1
            col = -1
            for c in (e for e in r if _local(e) == "c"):
                col = _column(c.get("r", "")) if c.get("r") else col + 1
                if row >= max_rows or col >= max_cols:
                    continue
                kind, value = c.get("t", "n"), next((e.text for e in c if _local(e) == "v"), None)
                if kind == "inlineStr":
                    yield sheet, row, col, "text", _paragraphs(c, set(), {"t"}), None
                elif value is None:
                    continue
                elif kind == "s":
                    yield sheet, row, col, "text", strings[int(value)], None
                elif kind == "b":
                    yield sheet, row, col, "boolean", "TRUE" if value == "1" else "FALSE", None
                elif kind in ("e", "str", "d"):
                    yield sheet, row, col, {"e": "error", "str": "text", "d": "date"}[kind], value, None
                elif int(c.get("s", -1)) in dates and (shown := serial_text(float(value), system)):
                    yield sheet, row, col, "date", shown, float(value)
                else:
                    yield sheet, row, col, "number", value, float(value)


def _ods_cells(package: _Package, max_rows: int, max_cols: int):
    get = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    for table in (e for e in package.xml("content.xml").iter() if _local(e) == "table"):
        row = 0
        for r in (e for e in table.iter() if _local(e) == "table-row"):
            repeat_row, cells, col = int(get(r, "number-rows-repeated") or 1), [], 0
            for c in (e for e in r if _local(e) in ("table-cell", "covered-table-cell")):
                repeat, kind = int(get(c, "number-columns-repeated") or 1), get(c, "value-type")
                text = _paragraphs(c, {"p"}, {"p", "span", "a", "*"}).strip()
                if kind or text:
                    num = get(c, "value")
                    shown = get(c, "date-value") or text
                    name = {"float": "number", "currency": "number", "percentage": "number", "boolean": "boolean", "date": "date"}.get(kind, "text")
                    cells += [(k, name, shown, float(num) if num else None) for k in range(col, min(col + repeat, max_cols))]
                col += repeat
            if cells:
                for k in range(row, min(row + repeat_row, max_rows)):
                    yield from ((get(table, "name") or "", k, *cell) for cell in cells)
            row += repeat_row


def spreadsheet_cells(files: DataFrame, max_rows: int = 1000, max_cols: int = 100) -> DataFrame:
    """CELLS of files(path, content) of xlsx and ods. Numbers that a workbook's style shows as dates are of type date,
    with ISO text; repeated rows and columns are expanded up to the caps, which are
    what a preview shows."""

    def read(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    package = _Package(bytes(content))
                    cells = _ods_cells if path.lower().endswith(".ods") else _xlsx_cells
                    rows += [(path, *cell, None) for cell in cells(package, max_rows, max_cols)]
                except Exception as error:  # whatever a damaged file raises is its row's error
                    rows.append((path, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInPandas(read, CELLS)


def serial_date(serial: Column, system: int = 1900) -> Column:
    """The date of a spreadsheet's day number. In the 1900 system day 60 never was, and has none."""
    day = F.floor(serial).cast("int")
    if system == 1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), day)
    return F.when(day == 60, None).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), F.when(day < 60, day + 1).otherwise(day)))
