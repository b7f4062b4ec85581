"""XLSX sheets as a format of Spark: ``spark.read.format("sheet").option("sheet", name).load(path)``.

A file is a partition; the sheet's XML is parsed as a stream, a row in memory at a time, beside the workbook's table of shared
strings. The first row names the columns, and all cells are text as they are stored: numbers keep their digits, so that codes
are judged by the rules for codes. A missing cell is null. A sheet that is not there is an error that lists those that are. Writing
gives a workbook of one sheet for each partition.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slopeworks.sources.files import FileWriter, listing, opened

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The fixed parts of a workbook of one sheet.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _tag(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ET.Element) -> str:
    """The text of all runs; phonetic hints are none."""
    return "".join(n.text or "" for c in element for n in ([c] if _tag(c) == "t" else c.iter() if _tag(c) == "r" else ()) if _tag(n) == "t")


def _ended(stream, wanted: str) -> Iterator[ET.Element]:
    """Elements of a name as they end; what has been read is let go."""
    above: list[ET.Element] = []
    for event, element in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if _tag(element) == wanted:
            yield element
            if above:
                above[-1].remove(element)


def column_of(reference: str) -> int:
    """The number of a cell's column, from its letters."""
    at = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        at = 26 * at + ord(c) - 64
    return at - 1


def sheet_rows(archive: zipfile.ZipFile, sheet: str | None, path: str) -> Iterator[list[str | None]]:
    book = ET.fromstring(archive.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): links[s.get(_REL)] for s in book.iter() if _tag(s) == "sheet"}
    if sheet is None:
        sheet = next(iter(sheets))
    if sheet not in sheets:
        raise ValueError(f"{path} has no sheet '{sheet}'; there are: {', '.join(sheets)}")
    target = sheets[sheet]
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [_text(e) for e in _ended(archive.open("xl/sharedStrings.xml"), "si")]
    for row in _ended(archive.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), "row"):
        cells: list[str | None] = []
        for cell in row:
            at = column_of(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value = next((c.text for c in cell if _tag(c) == "v"), None)
            kind = cell.get("t")
            if kind == "inlineStr":
                value = next((_text(c) for c in cell if _tag(c) == "is"), None)
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "b" and value is not None:
                value = "TRUE" if value.strip() == "1" else "FALSE"
            cells[at] = value
        yield cells


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.sheet, self.columns = options["path"], options.get("sheet"), columns

    def partitions(self) -> list[_File]:
        return [_File(p) for p in listing(self.path, (".xlsx",))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
            rows = sheet_rows(archive, self.sheet, partition.path)
            names = next(rows, [])
            missing = [c for c in self.columns if c not in names]
            if missing:
                raise ValueError(f"{partition.path} lacks columns: {', '.join(missing)}")
            at = [names.index(c) for c in self.columns]
            for cells in rows:
                if any(c is not None for c in cells):
                    yield tuple(cells[k] if k < len(cells) else None for k in at)


class SheetWriter(FileWriter):
    def __init__(self, folder: str, overwrite: bool, sheet: str):
        super().__init__(folder, overwrite)
        self.sheet = sheet

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        packed, count = io.BytesIO(), 0
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("[Content_Types].xml", _TYPES)
            archive.writestr("_rels/.rels", _LINKS.format(kind="officeDocument", target="xl/workbook.xml"))
            archive.writestr("xl/_rels/workbook.xml.rels", _LINKS.format(kind="worksheet", target="worksheets/sheet1.xml"))
            name = escape(self.sheet, {'"': "&quot;"})
            archive.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL[1:-3]}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for batch in batches:
                    if not count:
                        out.write(f"<row>{''.join(map(cell, batch.schema.names))}</row>".encode())
                    for row in zip(*(c.to_pylist() for c in batch.columns)):
                        out.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                        count += 1
                out.write(b"</sheetData></worksheet>")
        if count:
            yield f"{uuid.uuid4().hex}.xlsx", packed.getvalue()


class Sheet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        path = listing(self.options["path"], (".xlsx",))[0]
        with opened(path) as file, zipfile.ZipFile(file) as archive:
            names = next(sheet_rows(archive, self.options.get("sheet"), path), [])
        return T.StructType([T.StructField(n, T.StringType()) for n in names if n])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(self.options, schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], overwrite, self.options.get("sheet", "Sheet1"))
