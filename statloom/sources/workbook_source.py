"""``spark.read.format("workbook")``: the cells of all workbooks below a folder, a task a file.

Options: ``path`` (the folder, or one file), ``keyword`` (what a file's name holds, case aside),
``skip`` (names of folders that are passed over, apart by commas; that of duplicates unless
given) and ``category`` (in place of the name of the file's folder).  Besides the cells there is
a row for every file and every sheet that cannot be read, with what is wrong in ``bad``; nothing
is passed over silently.

Folders may lie wherever pyarrow reads (local or shared disks, and object stores by their
address).  For other stores ``grammar.read_cells`` takes the bytes from Spark's own reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import DUPLICATES_FOLDER
from .workbook import NotAWorkbook, all_sheets, cell_text

SCHEMA = "sheet string, category string, source string, row int, col int, text string, bad string"
_ARROW = pa.schema([("sheet", pa.string()), ("category", pa.string()), ("source", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("bad", pa.string())])
#: Cells of a batch.
BATCH = 16_384


class File(InputPartition):
    """One workbook: a task reads it."""

    def __init__(self, path: str):
        super().__init__(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") and "//" not in path else path.replace("file:/", "file:///", 1))


def found(folder: str, keyword: str = "", skip: str = DUPLICATES_FOLDER) -> list[str]:
    """The workbooks below a folder in the order of their paths; unfinished copies (~$) are none."""
    store, at = _store(folder)
    passed = [s for s in skip.split(",") if s]
    info = store.get_file_info(at)
    files = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    kept = []
    for file in files:
        below = file.path.split("/")
        if file.is_file and file.base_name.lower().endswith(".xlsx") and not file.base_name.startswith("~$") and keyword.lower() in file.base_name.lower() and not any(s in part for part in below[:-1] for s in passed):
            kept.append(file.path)
    return sorted(kept)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.category = options["path"], options.get("category")
        self.keyword, self.skip = options.get("keyword", ""), options.get("skip", DUPLICATES_FOLDER)

    def partitions(self) -> list[File]:
        return [File(path) for path in found(self.folder, self.keyword, self.skip)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # no file at all
            return
        folder, _, name = partition.value.rpartition("/")
        category = self.category or folder.rpartition("/")[2]
        key = lambda sheet: (f"{partition.value}#{sheet}" if sheet else partition.value, category, (f"{name}#{sheet}" if sheet else name)[:200])
        rows: list[tuple] = []
        try:
            with _store(self.folder)[0].open_input_file(partition.value) as file:
                data = file.read()
            for sheet, grid, wrong in all_sheets(data):
                if wrong is not None:
                    rows.append((*key(sheet), None, None, None, wrong))
                for r, line in enumerate(grid):
                    rows += [(*key(sheet), r, c, told, None) for c, value in enumerate(line) if (told := cell_text(value)) is not None]
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
        except (NotAWorkbook, OSError) as wrong:
            rows.append((*key(None), None, None, None, f"{type(wrong).__name__}: {wrong}"))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def read_workbooks(spark: SparkSession, folder: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(the cells, as ``grammar.records`` takes them; category, source and what is ``bad`` of each file and sheet that cannot be read)."""
    spark.dataSource.register(WorkbookSource)
    every = spark.read.format("workbook").options(**options).load(folder)
    return every.where("bad is null").drop("bad"), every.where("bad is not null").select("category", F.col("source"), "bad")


def put(path: str, data: bytes) -> None:
    """One small file, written where ``path`` says."""
    store, at = _store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def write_workbooks(cells: DataFrame, folder: str) -> DataFrame:
    """(file, sheets, bytes) of the workbooks written below a folder, one for each ``file``, from (file, sheet, row, col, text, number, date).

    A number is written where there is one, else a date, else the text.  A workbook is put together by one
    task, as its format asks for; a task that runs again writes the same file again.
    """
    import pandas as pd

    from .workbook import packed

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name, tables = pdf["file"].iloc[0], {}
        for sheet, row, col, text, number, day in zip(*(pdf[c] for c in ("sheet", "row", "col", "text", "number", "date")), strict=True):
            tables.setdefault(sheet, {})[int(row), int(col)] = float(number) if pd.notna(number) else day if pd.notna(day) else text
        data = packed(sorted(tables.items()))
        put(f"{folder.rstrip('/')}/{name}", data)
        return pd.DataFrame({"file": pd.Series([name], dtype=object), "sheets": [len(tables)], "bytes": [len(data)]})

    day = F.col("date").cast("date") if "date" in cells.columns else F.lit(None).cast("date").alias("date")
    return cells.select("file", "sheet", "row", "col", "text", F.col("number").cast("double").alias("number"), day).groupBy("file").applyInPandas(write, "file string, sheets long, bytes long")
