"""Sheets of fixed layout: macro figures, labour by district, wages, branches.

All take the cells of the sheet (sheet, row, col, text) and work by joins of heading cells
with the cells below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABOUR_DISTRICTS, MACRO_LABELS
from ..functions.text import number_of


def _first_part(text: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for part, name in reversed(names.items()):
        out = F.when(F.contains(text, F.lit(part)), name).otherwise(out)
    return out


def _year(text: Column, low: int, high: int) -> Column:
    year = F.when(text.rlike(r"^20\d\d"), F.substring(text, 1, 4).try_cast("int"))
    return F.when(year.between(low, high), year)


def _years(cells: DataFrame, row: int, low: int, high: int) -> DataFrame:
    return cells.where(F.col("row") == row).select("sheet", "col", _year(F.col("text"), low, high).alias("year")).where("year is not null")


def _macro_rows(cells: DataFrame) -> DataFrame:
    down = Window.partitionBy("sheet").orderBy("row")
    lines = cells.where("row >= 3").groupBy("sheet", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("label"), F.max(F.when(F.col("col") == 1, F.lower("text"))).alias("unit"))
    lines = lines.withColumn("indicator", F.last(_first_part(F.coalesce("label", F.lit("")), MACRO_LABELS), ignorenulls=True).over(down))
    lines = lines.where("indicator is not null and unit rlike 'mlrd|mln'").where(~F.col("unit").rlike("o'siw|ósim|%"))
    values = cells.join(_years(cells, 2, 2010, 2030), ["sheet", "col"]).select("sheet", "row", "year", number_of(F.col("text")).alias("value")).where("value is not null")
    return lines.join(values, ["sheet", "row"])


def _first_rows(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("sheet", "indicator").agg(F.min("row").alias("row"))
    return rows.join(first, ["sheet", "indicator", "row"]).select("year", "indicator", "value")


def macro(cells: DataFrame) -> DataFrame:
    """(year, indicator, value): for each label its first row in thousands of millions or millions; growth rows are left out."""
    return _first_rows(_macro_rows(cells))


def macro_filled(cells: DataFrame) -> DataFrame:
    """Like ``macro`` without zeros, which stand for figures not known yet; a label's first row is one that has others."""
    rows = _macro_rows(cells).where("value <> 0")
    return _first_rows(rows)


def labour(cells: DataFrame) -> DataFrame:
    """(district_id, year, active, employed, unemployed, rate): four columns for each year; rows with a gap are left out."""
    names = ("active", "employed", "unemployed", "rate")
    starts = _years(cells, 2, 2015, 2030).select("sheet", "year", F.posexplode(F.array(*[F.col("col") + i for i in range(4)])).alias("i", "col"))
    lines = cells.where("row >= 5 and col = 0").select("sheet", "row", _first_part(F.col("text"), LABOUR_DISTRICTS).alias("district_id")).where("district_id is not null")
    values = cells.join(starts, ["sheet", "col"]).join(lines, ["sheet", "row"]).select("district_id", "year", "row", "i", number_of(F.col("text")).alias("value"))
    wide = values.groupBy("district_id", "year", "row").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    return wide.dropna(subset=list(names)).drop("row")


def wages(cells: DataFrame) -> DataFrame:
    """(branch, year, quarter, value): the first of 8 rows with at least four quarters heads the columns."""
    quarters = cells.where("row < 8").where(F.contains("text", F.lit("Q")) & F.contains("text", F.lit("20")))
    head = quarters.groupBy("sheet", "row").count().where("count >= 4").groupBy("sheet").agg(F.min("row").alias("head"))
    found = quarters.join(head, "sheet").where(F.col("row") == F.col("head")).select("sheet", "head", "col", F.regexp_extract("text", r"(20\d\d)", 1).cast("int").alias("year"), F.regexp_extract("text", r"Q\s*(\d)", 1).cast("int").alias("quarter"))
    labels = cells.where("col = 0").select("sheet", "row", F.col("text").alias("branch"))
    rows = cells.join(found, ["sheet", "col"]).where(F.col("row") > F.col("head")).join(labels, ["sheet", "row"])
    return rows.select("branch", "year", "quarter", number_of(F.col("text")).alias("value")).where("value is not null")


def branches(cells: DataFrame, least: int = 8, above: float = 0.0, below: float | None = None) -> DataFrame:
    """(branch, year, value): values in a range of branches with at least so many of them.

    Industry asks for 8 above 0, growth for 5 between 80 and 200, services for 5 above 0; the
    first of 5 rows with as many years heads the columns.
    """
    years = cells.where("row < 5").select("sheet", "row", "col", _year(F.col("text"), 2010, 2030).alias("year")).where("year is not null")
    head = years.groupBy("sheet", "row").count().where(F.col("count") >= least).groupBy("sheet").agg(F.min("row").alias("head"))
    heads = years.join(head, "sheet").where(F.col("row") == F.col("head")).select("sheet", "head", "col", "year")
    labels = cells.where("col = 0").select("sheet", "row", F.substring("text", 1, 70).alias("branch")).where(~F.col("branch").rlike("^[¹*]"))
    rows = cells.join(heads, ["sheet", "col"]).where(F.col("row") > F.col("head")).join(labels, ["sheet", "row"])
    rows = rows.select("sheet", "row", "branch", "year", number_of(F.col("text")).alias("value")).where(F.col("value") > above)
    rows = rows if below is None else rows.where(F.col("value") < below)
    enough = rows.groupBy("sheet", "row").count().where(F.col("count") >= least).select("sheet", "row")
    return rows.join(enough, ["sheet", "row"], "left_semi").select("branch", "year", "value")


def _republic(cells: DataFrame, from_row: int) -> DataFrame:
    """(sheet, row) of the first row that names the republic."""
    named = cells.where((F.col("row") >= from_row) & (F.col("col") == 0) & F.col("text").rlike("Respublikas[iı]|Qaraqalpaqstan"))
    return named.groupBy("sheet").agg(F.min("row").alias("row"))


def passengers(cells: DataFrame) -> DataFrame:
    """(year, value): the republic's row below the years (2018 j.) of row 3; values above 0."""
    years = cells.where("row = 3").where(F.contains("text", F.lit("j."))).select("sheet", "col", _year(F.col("text"), 2000, 2099).alias("year")).where("year is not null")
    rows = cells.join(_republic(cells, 4), ["sheet", "row"]).join(years, ["sheet", "col"])
    return rows.select("year", number_of(F.col("text")).alias("value")).where("value > 0")


def enterprises(cells: DataFrame) -> DataFrame:
    """(year, value): active enterprises of the republic, the second column of each year's block.

    The first of 6 rows with at least four years heads the blocks; values above 0.
    """
    year = F.when(F.col("text").rlike(r"^\d{4}(\.0)?$"), F.substring("text", 1, 4).cast("int"))
    years = cells.where("row < 6").select("sheet", "row", "col", year.alias("year")).where(F.col("year").between(2009, 2030))
    head = years.groupBy("sheet", "row").agg(F.count_distinct("year").alias("n")).where("n >= 4").groupBy("sheet").agg(F.min("row").alias("row"))
    starts = years.join(head, ["sheet", "row"]).groupBy("sheet", "year").agg((F.max("col") + 1).alias("col"))
    rows = cells.join(_republic(cells, 6), ["sheet", "row"]).join(starts, ["sheet", "col"])
    return rows.select("year", number_of(F.col("text")).alias("value")).where("value > 0")


def labour_total(cells: DataFrame) -> DataFrame:
    """The republic's own row of labour figures, by year."""
    return labour(cells).where(F.col("district_id") == next(iter(LABOUR_DISTRICTS.values())))
