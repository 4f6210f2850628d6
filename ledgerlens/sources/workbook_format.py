"""S1 and K8 as a Spark data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

Reading: a partition per .xlsx file of a folder; the columns are those of the
first workbook's header (by path), or those named by the option ``columns``.
Cells are text.  Writing: every task writes workbooks of its own rows, each
with the header, numbers as number cells and all else as text; they appear in
the folder when the job commits, and a job without rows writes none.

Paths are opened on the driver and on executors by pyarrow's file systems:
local or mounted folders, or a URI that pyarrow knows.  Stores that only Spark
can open are read by ``workbook.workbook_table`` instead.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.session import ship_package
from ledgerlens.sources.workbook import Workbook

#: Data rows of one sheet; the format allows 1,048,576 with the header.
SHEET_ROWS = 1_000_000
_OWN = ("path", "row_idx")
_UNWRITABLE = re.compile(r"[\x00-\x08\x0b-\x1f]")

# The parts of a workbook file besides its sheet.
_PARTS = {
    "[Content_Types].xml":
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        '</Types>',
    "_rels/.rels":
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml":
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Data Hygiene Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels":
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _workbooks(folder: str) -> list[str]:
    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".xlsx") and f.base_name[0] not in "_.")


def _open(folder: str, path: str) -> Workbook:
    with _store(folder)[0].open_input_file(path) as file:
        return Workbook(file.read())


def _cell(value: object) -> str:
    """A cell: numbers as numbers, null as an empty text."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value!r}</v></c>"
    text = "" if value is None else str(value)
    # What XML can't hold is written as the format's escapes are.
    text = _UNWRITABLE.sub(lambda c: f"_x{ord(c[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook_bytes(names: list[str], rows: Iterator[tuple]) -> bytes:
    """A workbook of the next SHEET_ROWS rows; sheets are streamed into the archive."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for part, text in _PARTS.items():
            archive.writestr(part, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with archive.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for row in chain([names], islice(rows, SHEET_ROWS)):
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return buffer.getvalue()


class WorkbookFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        names = [n for n in self.options.get("columns", "").split("|") if n]
        if not names:
            folder = self.options["path"]
            books = _workbooks(folder)
            header = next(_open(folder, books[0]).rows(), []) if books else []
            names = list(dict.fromkeys(n.strip() for n in header if n.strip()))
        return StructType([StructField("path", StringType()), StructField("row_idx", LongType()), *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], [n for n in schema.names])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        writer = WorkbookWriter(self.options["path"], schema.names, overwrite)
        writer.begin()
        return writer


@dataclass
class Book(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self) -> list[InputPartition]:
        return [Book(path) for path in _workbooks(self.folder)]

    def read(self, partition: Book) -> Iterator[tuple]:
        if not isinstance(partition, Book):  # no workbook, no partition
            return
        rows = _open(self.folder, partition.path).rows()
        place = {name.strip(): k for k, name in enumerate(next(rows, [])) if name.strip()}
        wanted = [place.get(n, -1) for n in self.names if n not in _OWN]
        for i, cells in enumerate(rows):
            values = [None if k < 0 else cells[k] if k < len(cells) else "" for k in wanted]
            yield tuple({"path": partition.path, "row_idx": i}[n] if n in _OWN else values.pop(0) for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[str]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = folder, names, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def begin(self) -> None:
        """Make the folder that tasks write into; a task that goes on after an abort finds none and fails, and leaves nothing."""
        store, path = _store(self.folder)
        store.create_dir(f"{path}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = _store(self.folder)
        task, files = TaskContext.get(), []
        rows = (tuple(r) for r in iterator)
        while (first := next(rows, None)) is not None:
            # Attempts of one task write apart; the files of the one that commits count.
            name = f"{path}/{self.staging}/{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):03d}.xlsx"
            rest = chain([first], rows)
            with store.open_output_stream(name) as out:
                out.write(workbook_bytes(self.names, rest))
            rows = rest
            files.append(name)
        return Written(task.partitionId(), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.folder)
        if self.overwrite:
            for old in _workbooks(self.folder):
                store.delete_file(old)
        done = sorted((m.partition, f) for m in messages if m for f in m.files)
        taken = len(_workbooks(self.folder)) if done else 0
        for number, (_, name) in enumerate(done):
            store.move(name, f"{path}/part-{taken + number:05d}.xlsx")
        self._clear(store, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and the package to its Python workers."""
    ship_package(spark)
    spark.dataSource.register(WorkbookFormat)


def read_workbooks(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("workbook")
    return (reader.option("columns", "|".join(columns)) if columns else reader).load(folder)


def write_workbooks(df: DataFrame, folder: str) -> None:
    """K8: the rows as workbooks in ``folder``, in place of those there; none without rows."""
    register(df.sparkSession)
    df.write.format("workbook").mode("overwrite").save(folder)
