"""A folder of .xlsx workbooks -> rows, read on the executors in one pass.

``binaryFile`` lists the files; each task streams the first sheet of its
workbooks and emits rows that already carry their header's names, in chunks
of bounded size.  Workbooks spread over tasks; one workbook (a compressed
archive) is read by one task.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from functools import cached_property
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ship_package

# Names of the spreadsheet format's vocabularies.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL, _VALUE, _RUN = f"{MAIN}c", f"{MAIN}v", f"{MAIN}t"

#: Rows that a task holds before it hands them on.
CHUNK_ROWS = 2000


class Workbook:
    """The first sheet of a workbook, row by row."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.parts = set(self.archive.namelist())
        # How the text of a cell is found, by its declared type; numbers, booleans and formula results are as written.
        self.decoders: dict[str, Callable[[ElementTree.Element], str]] = {
            "s": lambda cell: self.strings[int(number)] if (number := cell.findtext(_VALUE)) else "",
            "inlineStr": self._plain,
        }

    @cached_property
    def strings(self) -> list[str]:
        return [self._plain(item) for item in self._elements("xl/sharedStrings.xml", "si")]

    @staticmethod
    def _plain(node: ElementTree.Element) -> str:
        # One run in one item, as nearly all are.
        if len(node) == 1 and len(node[0]) == 1 and node[0][0].tag == _RUN and not len(node[0][0]) and node[0].tag != _RUN and node.tag != _RUN:
            return node[0][0].text or ""
        return "".join(run.text for run in node.iter(f"{MAIN}t") if run.text)

    def _elements(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of a part as they end; each is emptied once it has been used."""
        wanted = MAIN + tag
        if part in self.parts:
            with self.archive.open(part) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if node.tag == wanted:
                        yield node
                        node.clear()

    def first_sheet(self) -> str | None:
        """The part that the workbook lists first; the first by name if the list or its links are missing."""
        targets = {}
        if "xl/_rels/workbook.xml.rels" in self.parts:
            for link in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels")):
                targets[link.get("Id")] = posixpath.normpath(posixpath.join("/xl", link.get("Target", ""))).lstrip("/")
        listed = [targets.get(sheet.get(LINK)) for sheet in self._elements("xl/workbook.xml", "sheet")]
        named = sorted(p for p in self.parts if p.startswith("xl/worksheets/") and p.endswith(".xml"))
        return next((p for p in [*listed, *named] if p in self.parts), None)

    def rows(self) -> Iterator[list[str]]:
        """Cells by column; columns without a cell are '' up to the last one that has one."""
        sheet = self.first_sheet()
        for row in self._elements(sheet, "row") if sheet else ():
            values: list[str] = []
            for cell in row:
                if cell.tag != _CELL:
                    continue
                decode = self.decoders.get(cell.get("t", ""))
                value = decode(cell) if decode else cell.findtext(_VALUE) or ""
                place = column_number(cell.get("r", ""))
                if place:
                    values.extend([""] * (place - len(values)))
                    values[place - 1] = value
                else:
                    values.append(value)
            yield values


def column_number(reference: str) -> int:
    """'A1' -> 1, 'AB7' -> 28: letters as digits of base 26; 0 without letters."""
    letters = reference.rstrip("0123456789")
    if not letters:
        return 0
    return sum((int(c, 36) - 9) * 26**power for power, c in enumerate(reversed(letters)))


def _read(files: DataFrame, schema: str, fields: pa.Schema, records: Callable[[str, Workbook], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for record in records(path.as_py(), Workbook(content.as_py())):
                    held.append(record)
                    if len(held) == CHUNK_ROWS:
                        yield chunk(held)
                        held = []
        if held:
            yield chunk(held)

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row_idx, cells) for every row of every workbook, header rows included."""
    fields = pa.schema([("path", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
    return _read(_files(spark, folder), "path string, row_idx long, cells array<string>", fields,
                 lambda path, book: ((path, i, cells) for i, cells in enumerate(book.rows())))


def workbook_table(spark: SparkSession, folder: str, lower_headers: bool = False) -> DataFrame:
    """(path, row_idx, values): data rows from 0, their cells by header name.

    Names are stripped of all white space at their ends.  A column without a
    name is left out; of columns that share a name the last counts, as when
    a row is read into a mapping.  A row that ends early has '' in the rest.
    """
    fields = pa.schema([("path", pa.string()), ("row_idx", pa.int64()), ("values", pa.map_(pa.string(), pa.string()))])

    def records(path: str, book: Workbook) -> Iterator[tuple]:
        rows = book.rows()
        names = [n.strip().lower() if lower_headers else n.strip() for n in next(rows, [])]
        for i, cells in enumerate(rows):
            values = {name: cells[k] if k < len(cells) else "" for k, name in enumerate(names) if name}
            yield path, i, list(values.items())

    return _read(_files(spark, folder), "path string, row_idx long, values map<string,string>", fields, records)


def workbook_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, names) of every workbook that has a data row: its columns' names once each, in their order.

    Only the beginning of a sheet is read.
    """
    fields = pa.schema([("path", pa.string()), ("names", pa.list_(pa.string()))])

    def records(path: str, book: Workbook) -> Iterator[tuple]:
        rows = book.rows()
        names = [n.strip() for n in next(rows, [])]
        if next(rows, None) is not None:
            yield path, list(dict.fromkeys(n for n in names if n))

    return _read(_files(spark, folder), "path string, names array<string>", fields, records)


def workbook_columns(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(_at, *names): data rows under ``names``, which ``workbook_headers`` has found; _at: path and row_idx, from 0.

    A column may itself be called path or row_idx.  As ``workbook_table`` has them: null where a workbook lacks the column, ''
    where a row ends early, of columns that share a name the last.
    """
    fields = pa.schema([("path", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])

    def records(path: str, book: Workbook) -> Iterator[tuple]:
        rows = book.rows()
        place = {name.strip(): k for k, name in enumerate(next(rows, []))}
        wanted = [place.get(n, -1) for n in names]
        for i, cells in enumerate(rows):
            yield path, i, [None if k < 0 else cells[k] if k < len(cells) else "" for k in wanted]

    table = _read(_files(spark, folder), "path string, row_idx long, cells array<string>", fields, records)
    return table.select(F.struct("path", "row_idx").alias("_at"), *[F.col("cells")[k].alias(n) for k, n in enumerate(names)])


def select_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns of ``workbook_table`` output; null where a workbook lacks one."""
    return table.select("path", "row_idx", *[F.col("values")[c].alias(c) for c in columns])
