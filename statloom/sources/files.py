"""Tabular files in and out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DUPLICATES_FOLDER
from ..functions.text import number_of
from .workbook import NotAWorkbook, sheets

PLAN_COLUMNS = {
    "module": "string", "region": "string", "year": "int", "period": "string", "period_type": "string", "month": "int", "quarter": "int",
    "kpi_planned": "double", "kpi_actual": "double", "unit": "string", "status": "string", "comment": "string",
}
REQUIRED = ["module", "region", "year"]


def bulk_plans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV with header that can be loaded, and those that can't with their ``error``."""
    return checked_plans(spark.read.option("header", True).csv(path))


def bulk_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Like ``bulk_plans``, for the first sheets of workbooks; the first row of each holds the names.

    A workbook that cannot be read or lacks a column is one row with its ``error``; the others are loaded.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = list(PLAN_COLUMNS)

    def unpack(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name, none = path.rpartition("/")[2], [None] * len(names)
                try:
                    grid = sheets(bytes(content))[0][1]
                except (NotAWorkbook, IndexError):
                    rows.append([*none, f"{name}: no workbook"])
                    continue
                head = {str(v).strip(): i for i, v in enumerate(grid[0]) if v is not None} if grid else {}
                if missing := [c for c in REQUIRED if c not in head]:
                    rows.append([*none, f"{name}: missing columns: {', '.join(missing)}"])
                    continue
                plain = lambda v: None if v is None else f"{v:.15g}" if isinstance(v, float) else str(v)
                rows += [[*(plain(line[head[n]]) if n in head and head[n] < len(line) else None for n in names), None] for line in grid[1:] if any(v is not None for v in line)]
            yield pd.DataFrame(rows, columns=[*names, "bad"], dtype=object)

    raw = files.mapInPandas(unpack, ", ".join(f"`{n}` string" for n in [*names, "bad"]))
    good, wrong = checked_plans(raw.where("bad is null").drop("bad"))
    return good, wrong.unionByName(raw.where("bad is not null").select(F.col("bad").alias("error")), allowMissingColumns=True)


def checked_plans(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts that can be loaded, and those that can't with their ``error``.

    module, region and year are needed; numbers that aren't numbers are errors; columns
    that are absent are null, status is in_progress where empty.
    """
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns, errors = [], []
    for name, kind in PLAN_COLUMNS.items():
        value = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        value = F.nullif(F.trim(value), F.lit(""))
        typed = value if kind == "string" else number_of(value).cast(kind)
        columns.append(typed.alias(name))
        if kind != "string":
            errors.append(F.when(value.isNotNull() & typed.isNull(), F.concat(F.lit(f"{name}: "), value)))
        if name in REQUIRED:
            errors.append(F.when(value.isNull(), f"{name} is empty"))
    rows = raw.select(*columns, F.concat_ws("; ", *errors).alias("error"))
    good = rows.where("error = ''").drop("error").withColumn("status", F.coalesce("status", F.lit("in_progress")))
    return good, rows.where("error <> ''")


#: Reports are written as one file, and gathered in one row, only up to so many rows.
REPORT_ROWS = 100_000


def _few(df: DataFrame) -> bool:
    return df.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS


def write_csv(df: DataFrame, path: str) -> None:
    """With header; one file for a report of few rows, else a file for each task."""
    (df.coalesce(1) if _few(df) else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(**parts: DataFrame) -> DataFrame:
    """One row of JSON text with each part's rows; refuses parts of over ``REPORT_ROWS``."""
    out = None
    for name, df in parts.items():
        if not _few(df):
            raise ValueError(f"too many rows for a report: {name}")
        rows = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))


def dialogues(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """system, human and gpt texts of ShareGPT JSON (one array a file, or a line for each), empty where a turn is absent."""
    raw = spark.read.schema("conversations array<struct<from:string,value:string>>").option("multiLine", not lines).json(path)
    said = lambda who: F.coalesce(F.get(F.filter("conversations", lambda c: c["from"] == who), F.lit(0))["value"], F.lit(""))
    return raw.select(said("system").alias("system"), said("human").alias("human"), said("gpt").alias("gpt"))


def sharegpt(pairs: DataFrame, system: str) -> DataFrame:
    """One row of turns (system, human, gpt) for each pair (human, gpt), ready for ``write_json``."""
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    return pairs.select(F.array(turn("system", F.lit(system)), turn("human", F.col("human")), turn("gpt", F.col("gpt"))).alias("conversations"))


def chat_text(turns: DataFrame) -> DataFrame:
    """The rows (system, human, gpt) with ``text``: their turns with marks around them, as a chat model is trained on; an empty system turn is left out."""
    turn = lambda who, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<|im_start|>{who}\n"), c, F.lit("<|im_end|>\n"))).otherwise("")
    said = lambda who, c: F.concat(F.lit(f"<|im_start|>{who}\n"), F.coalesce(c, F.lit("")), F.lit("<|im_end|>\n"))
    return turns.withColumn("text", F.concat(turn("system", F.col("system")), said("user", F.col("human")), said("assistant", F.col("gpt"))))


def find_workbooks(spark: SparkSession, folder: str, keyword: str = "") -> DataFrame:
    """path and name, in the order of paths, of the workbooks below a folder whose name holds the keyword; duplicates' folders are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kept = files.where(name.rlike(r"(?i)\.xlsx?$") & ~name.startswith("~$") & ~F.contains("path", F.lit(DUPLICATES_FOLDER)))
    return kept.where(F.contains(F.lower(name), F.lit(keyword.lower()))).select("path", name.alias("name")).orderBy("path")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with a whole-number column read in as many ranges of it as there are parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    whole = reader.load()
    low, high = whole.agg(F.min(column), F.max(column)).first() if column else (None, None)  # reads this column alone
    if low is None or low == high:
        return whole
    return reader.option("partitionColumn", column).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def svg_paths(spark: SparkSession, path: str) -> DataFrame:
    """file, view, place (in the file, from 0) and d of each path of SVG files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    view = F.regexp_extract("value", r'viewBox="([^"]+)"', 1)
    return files.select("file", view.alias("view"), F.posexplode(F.regexp_extract_all("value", F.lit(r'<path[^>]*?\sd="([^"]+)"'), 1)).alias("place", "d"))


def geometry_text(shapes: DataFrame, name: str = "SHAPES") -> DataFrame:
    """One row of TypeScript that exports the shapes (id, label_x, label_y, x0, y0, x1, y1, d) in the order of ids."""
    if not _few(shapes):
        raise ValueError("too many shapes for one file")
    number = lambda c: F.round(F.col(c), 1).cast("string")
    box = F.concat(F.lit("["), F.concat_ws(", ", *map(number, ("x0", "y0", "x1", "y1"))), F.lit("]"))
    line = F.concat(F.lit('  { id: "'), F.col("id").cast("string"), F.lit('", labelX: '), number("label_x"), F.lit(", labelY: "), number("label_y"), F.lit(", bbox: "), box, F.lit(', d: "'), F.col("d"), F.lit('" },'))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return shapes.agg(F.concat(F.lit(f"export const {name} = [\n"), F.array_join(lines, "\n"), F.lit("\n];")).alias("text"))
