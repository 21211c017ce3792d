"""From the cells of sheets to records: the three shapes of statistical tables.

Cells are rows (sheet, category, source, row, col, text).  Everything a table's layout says
is worked out by grouping and windows over the cells of a sheet: which row heads the
periods, what stands above it, which column holds the labels, which names are carried
down.  A sheet is read in the first shape that gives records: periods in columns, periods
in rows, districts in columns.  A sheet is one table made by hand, so windows by sheet stay
small; many sheets are spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DUPLICATES_FOLDER, REPUBLIC
from ..functions.cells import is_breakdown, month_span, parsed_period, unit_alone, unit_in_brackets, year_heading
from ..functions.text import district_form, district_of, looks_like_unit, number_of
from ..lineage import cut, numbered
from .workbook import NotAWorkbook, cell_text, sheets

CELLS = "sheet string, category string, source string, row int, col int, text string"
DASH = " — "


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            folder, file = path.split("/")[-2:]
            try:
                found = sheets(bytes(content))
            except NotAWorkbook:
                continue
            for name, grid in found:
                key = (f"{path}#{name}", folder, f"{file}#{name}"[:200])
                rows += [(*key, r, c, t) for r, line in enumerate(grid) for c, v in enumerate(line) if (t := cell_text(v)) is not None]
        yield pd.DataFrame(rows, columns=["sheet", "category", "source", "row", "col", "text"])


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The filled cells of all workbooks below a folder; files that are no workbooks give none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(folder)
    files = files.where(~F.contains("path", F.lit(DUPLICATES_FOLDER))).select("path", "content")
    return files.mapInPandas(_cells, CELLS)


def _joined(*parts: Column) -> Column:
    """The parts that aren't empty, with dashes; at most 300 characters."""
    kept = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != "")
    return F.substring(F.regexp_replace(F.array_join(kept, DASH), "^[ —]+|[ —]+$", ""), 1, 300)


def _preamble(cells: DataFrame, head: DataFrame, last: Column) -> DataFrame:
    """title (the longest) and texts (in reading order) of the cells of more than 3 characters up to a row."""
    above = cells.join(head, "sheet").where((F.col("row") <= last) & (F.length("text") > 3))
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", flat.alias("text"))))
    return above.groupBy("sheet").agg(
        F.max_by(flat, F.struct(F.length(flat), -F.col("row"), -F.col("col"))).alias("title"), F.transform(ordered, lambda c: c["text"]).alias("texts")
    )


def _with_preamble(rows: DataFrame, preamble: DataFrame) -> DataFrame:
    rows = rows.join(preamble, "sheet", "left")
    return rows.withColumn("texts", F.coalesce("texts", F.array().cast("array<string>"))).withColumn("title", F.coalesce("title", F.lit("")))


def _unit(label: Column) -> Column:
    """The unit from brackets in the label, then above the table, then a short text above it."""
    return F.coalesce(unit_in_brackets(F.concat(F.array(label), F.col("texts"))), unit_alone(F.col("texts")), F.lit(""))


def _district(label: Column) -> Column:
    return district_of(district_form(label))


def _record(indicator: Column, unit: Column, district: Column, block: Column) -> list[Column]:
    place = F.when(district != REPUBLIC, district)
    return [
        "category", indicator.alias("indicator"), unit.alias("unit"), place.alias("district_id"), F.col("p.year").alias("year"), F.col("p.period").alias("period"),
        F.col("p.period_no").alias("period_no"), F.col("value"), "source", "row", block.cast("int").alias("block"), "sheet", "col",
    ]


def _heads(cells: DataFrame) -> DataFrame:
    """(sheet, head, col, p): the period columns of each sheet's heading row, of the first 10 the one with most, at least 3."""
    top = cells.where("row < 10")
    direct = top.select("sheet", F.col("row").alias("head"), "col", parsed_period(F.col("text")).alias("p")).where("p is not null")
    enough = direct.groupBy("sheet", "head").count().where("count >= 3").select("sheet", "head")
    upward = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    years = cells.groupBy("sheet", "row").agg(F.min_by(year_heading(F.col("text")), F.when(year_heading(F.col("text")).isNotNull(), F.col("col"))).alias("year"))
    years = years.withColumn("above", F.last("year", ignorenulls=True).over(upward)).select("sheet", F.col("row").alias("head"), "above")
    spans = top.select("sheet", F.col("row").alias("head"), "col", month_span(F.col("text")).alias("month")).where("month is not null")
    spans = spans.join(years, ["sheet", "head"]).where("above is not null").join(enough, ["sheet", "head"], "left_anti")
    full = F.col("month") == 12
    spanned = spans.select("sheet", "head", "col", F.struct(F.col("above").alias("year"), F.when(full, "year").otherwise("ytd").alias("period"), F.when(~full, F.col("month")).alias("period_no")).alias("p"))
    rows = direct.join(enough, ["sheet", "head"]).unionByName(spanned)
    hits = rows.groupBy("sheet", "head").count().where("count >= 3")
    best = hits.groupBy("sheet").agg(F.max_by("head", F.struct(F.col("count"), -F.col("head"))).alias("head"))
    return rows.join(best, ["sheet", "head"])


def _groups(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """(sheet, col, group): captions above period columns where tables stand side by side.

    The nearest row above with 2 marks or more, but on no more than half the columns, is
    taken if its marks, carried to the right, tell period columns apart.
    """
    span = heads.groupBy("sheet").agg(F.min("head").alias("head"), F.min("col").alias("first"), F.max("col").alias("last"), F.count("*").alias("n")).where("n >= 4")
    marks = cells.join(span, "sheet").where((F.col("row") < F.col("head")) & F.col("col").between(F.col("first"), F.col("last")) & (F.length("text") < 60))
    sparse = marks.groupBy("sheet", "row").agg(F.count("*").alias("m"), F.first("n").alias("n")).where((F.col("m") >= 2) & (F.col("m") <= F.floor(F.col("n") / 2))).select("sheet", "row")
    none = F.lit(None)
    places = sparse.join(heads.select("sheet", "col"), "sheet").select("sheet", "row", "col", F.lit(True).alias("period"), none.cast("string").alias("mark"))
    marked = marks.join(sparse, ["sheet", "row"]).select("sheet", "row", "col", none.cast("boolean").alias("period"), F.col("text").alias("mark"))
    line = places.unionByName(marked).groupBy("sheet", "row", "col").agg(F.max("period").alias("period"), F.max("mark").alias("mark"))  # marks may stand between period columns
    right = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("group", F.coalesce(F.last("mark", ignorenulls=True).over(right), F.lit(""))).where("period")
    telling = line.groupBy("sheet", "row").agg(F.count_distinct("group").alias("k")).where("k >= 2")
    nearest = telling.groupBy("sheet").agg(F.max("row").alias("row"))
    return line.join(nearest, ["sheet", "row"]).select("sheet", "col", "group")


def _blocks(districts: Column) -> Column:
    """For districts in order: how many times one came again since its list began anew."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("nos"))

    def step(state: Column, district: Column) -> Column:
        again = F.array_contains(state["seen"], district)
        no = state["no"] + again.cast("int")
        seen = F.when(again, F.array(district)).otherwise(F.concat(state["seen"], F.array(district)))
        return F.struct(seen.alias("seen"), no.alias("no"), F.concat(state["nos"], F.array(no)).alias("nos"))

    return F.aggregate(districts, start, step, lambda s: s["nos"])


def wide_records(cells: DataFrame) -> DataFrame:
    """Records of sheets with periods in columns."""
    heads = cut(_heads(cells)).withColumn("low", F.min("col").over(Window.partitionBy("sheet")))
    head = heads.select("sheet", "head", "low").distinct()
    below = cells.join(head, "sheet").where(F.col("row") > F.col("head"))
    labelled = below.where(F.col("col") < F.col("low")).groupBy("sheet", "col").count().where("count >= 3")
    label_col = labelled.groupBy("sheet").agg(F.min("col").alias("label_col"))
    head = head.join(label_col, "sheet", "left").withColumn("label_col", F.coalesce("label_col", F.lit(0)))
    unit_col = F.when(F.col("low") - F.col("label_col") >= 2, F.col("low") - 1)

    # One row for each sheet row: its label, its unit cell, whether it holds values.
    below = below.drop("head", "low").join(head, "sheet").join(heads.select("sheet", "col", F.lit(True).alias("in_period")), ["sheet", "col"], "left")
    lines = below.groupBy("sheet", "row").agg(
        F.max(F.when(F.col("col") == F.col("label_col"), F.col("text"))).alias("own"),
        F.max(F.when(F.col("col") == unit_col, F.col("text"))).alias("beside"),
        F.bool_or(F.coalesce("in_period", F.lit(False))).alias("filled"),
    )
    # Rows without any cell go on with the label above them, too.
    last = cells.groupBy("sheet").agg(F.max("row").alias("last")).join(head.select("sheet", "head"), "sheet").where(F.col("last") > F.col("head"))
    every = last.select("sheet", F.explode(F.sequence(F.col("head") + 1, F.col("last"))).alias("row"))
    lines = every.join(lines, ["sheet", "row"], "left").withColumn("filled", F.coalesce("filled", F.lit(False)))
    down = Window.partitionBy("sheet").orderBy("row")
    marker = F.coalesce(is_breakdown(F.col("own")), F.lit(False))
    lines = lines.withColumn("marker", marker)
    # A marker's parent is the last filled and named row before it; parts last until the next marker's parent.
    parent = F.when(F.col("filled") & F.col("own").isNotNull() & ~F.col("marker"), F.struct("row", "own"))
    lines = lines.withColumn("parent", F.last(parent, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    opened = F.when(F.col("marker"), F.struct(F.col("row").alias("marked"), F.col("parent.own").alias("name"), F.col("parent.row").alias("from_row")))
    lines = lines.withColumn("open", F.last(opened, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("next", F.first(opened, ignorenulls=True).over(down.rowsBetween(1, Window.unboundedFollowing)))
    part = F.col("open").isNotNull() & (F.col("next").isNull() | (F.col("row") < F.coalesce(F.col("next.from_row"), F.col("next.marked"))))
    lines = lines.withColumn("part_of", F.when(part, F.col("open.name")))
    lines = lines.where("not marker").withColumn("label", F.last("own", ignorenulls=True).over(down)).where("label is not null")
    lines = cut(lines.withColumn("district", _district(F.col("label"))).select("sheet", "row", "label", "beside", "part_of", "district"))

    # Lists of districts that begin anew are blocks, captioned by the last other label before.
    listed = lines.where("district is not null").groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("row", "district"))).alias("d"))
    listed = listed.select("sheet", F.inline(F.arrays_zip(F.col("d.row").alias("row"), _blocks(F.col("d.district")).alias("block"))))
    caption = F.last(F.when(F.col("district").isNull(), F.col("label")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("caption", caption).join(listed.toDF("sheet", "row", "block"), ["sheet", "row"], "left")
    starts = Window.partitionBy("sheet", "block").orderBy("row")
    lines = lines.withColumn("caption", F.when(F.col("block") > 0, F.first("caption").over(starts)))
    lines = cut(lines).withColumn("block", F.coalesce("block", F.max("block").over(down.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))

    values = cells.join(heads, ["sheet", "col"]).where(F.col("row") > F.col("head")).withColumn("value", number_of(F.col("text"))).where("value is not null")
    rows = values.select("sheet", "category", "source", "row", "col", "p", "value").join(lines, ["sheet", "row"])
    rows = _with_preamble(rows, _preamble(cells, head.select("sheet", "head"), F.col("head") - 1)).join(_groups(cells, heads), ["sheet", "col"], "left")
    extra = F.when(F.col("beside") != F.col("label"), F.col("beside"))
    unit = F.when(F.coalesce(looks_like_unit(F.col("beside")), F.lit(False)), F.col("beside")).otherwise(_unit(F.col("label")))
    by_district = _joined(F.col("title"), F.col("caption"), F.col("group"))
    by_label = _joined(F.col("title"), F.col("part_of"), F.col("label"), extra, F.col("group"))
    return rows.select(*_record(F.when(F.col("district").isNotNull(), by_district).otherwise(by_label), unit, F.col("district"), F.col("block")))


def vertical_records(cells: DataFrame) -> DataFrame:
    """Records of sheets with periods down the first column, at least 3."""
    first = cells.where("col = 0").select("sheet", "row", F.col("text").alias("label"), parsed_period(F.col("text")).alias("p"))
    sheets_ = first.where("p is not null").groupBy("sheet").agg(F.count("*").alias("n"), F.min("row").alias("start")).where("n >= 3").select("sheet", "start")
    down = Window.partitionBy("sheet").orderBy("row")
    lines = first.join(sheets_, "sheet").where(F.col("row") >= F.col("start"))
    lines = lines.withColumn("head", F.col("p").isNotNull()).withColumn("p", F.last("p", ignorenulls=True).over(down))
    lines = lines.withColumn("district", F.when(~F.col("head"), _district(F.col("label")))).where("head or district is not null")

    # Column names: headings carried to the right, distinct ones joined downwards.
    top = cells.join(sheets_, "sheet").where(F.col("row") < F.col("start"))
    width = cells.groupBy("sheet").agg(F.max("col").alias("last"))
    grid = top.select("sheet", "row").distinct().join(width, "sheet").select("sheet", "row", F.explode(F.sequence(F.lit(0), "last")).alias("col"))
    right = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    flat = F.trim(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    carried = grid.join(top.select("sheet", "row", "col", flat.alias("text")), ["sheet", "row", "col"], "left").withColumn("text", F.last("text", ignorenulls=True).over(right))
    carried = carried.where(F.col("text").isNotNull() & ~is_breakdown(F.col("text")) & (F.col("col") > 0))
    names = carried.groupBy("sheet", "col").agg(F.sort_array(F.collect_list(F.struct("row", "text"))).alias("n"))
    names = names.select("sheet", "col", F.array_join(F.array_distinct(F.transform("n", lambda x: x["text"])), DASH).alias("name"))
    own = F.coalesce(unit_in_brackets(F.array("name")), F.lit(""))
    names = names.withColumn("own_unit", own).withColumn("any_unit", F.max(F.col("own_unit") != "").over(Window.partitionBy("sheet")))

    values = cells.where("col > 0").withColumn("value", number_of(F.col("text"))).where("value is not null")
    rows = values.join(lines.select("sheet", "row", "p", "district"), ["sheet", "row"]).join(names, ["sheet", "col"])
    rows = _with_preamble(rows, _preamble(cells, sheets_, F.col("start") - 1))
    shared = F.when(F.col("any_unit"), "").otherwise(_unit(F.lit("")))
    unit = F.when(F.col("own_unit") != "", F.col("own_unit")).otherwise(shared)
    return rows.select(*_record(_joined(F.col("title"), F.col("name")), unit, F.col("district"), F.lit(0)))


def district_column_records(cells: DataFrame) -> DataFrame:
    """Records of sheets with at least 5 districts across one of the first 12 rows, the period above."""
    named = cells.where("row < 12").withColumn("district", _district(F.col("text"))).where("district is not null")
    enough = named.groupBy("sheet", "row").count().where("count >= 5")
    head = enough.groupBy("sheet").agg(F.min("row").alias("head"))
    columns = named.join(head, "sheet").where(F.col("row") == F.col("head")).select("sheet", "head", "col", "district")
    preamble = _preamble(cells, head, F.col("head"))
    preamble = preamble.withColumn("p", F.get(F.filter(F.transform("texts", parsed_period), lambda p: p.isNotNull()), F.lit(0))).where("p is not null")
    labels = cells.where("col = 0").select("sheet", "row", F.col("text").alias("label")).where(~is_breakdown(F.col("label")))
    values = cells.withColumn("value", number_of(F.col("text"))).where("value is not null")
    rows = values.join(columns, ["sheet", "col"]).where(F.col("row") > F.col("head")).join(labels, ["sheet", "row"]).join(preamble, "sheet")
    return rows.select(*_record(_joined(F.col("title"), F.col("label")), _unit(F.col("label")), F.col("district"), F.lit(0)))


def records(cells: DataFrame) -> DataFrame:
    """The records of all sheets, each in the first shape that gives any, with ``ord`` in reading order.

    Cells and each shape's records are written before they are used again: workbooks are
    unpacked once, and plans stay small.
    """
    cells = cut(cells)
    out = cut(wide_records(cells))
    for shape in (vertical_records, district_column_records):
        rest = cut(cells.join(out.select("sheet").distinct(), "sheet", "left_anti"))
        out = out.unionByName(cut(shape(rest)))
    number = numbered(out.select("sheet").distinct(), "no", "sheet").withColumn("no", F.col("no").cast("long"))
    place = F.col("no") * (1 << 36) + F.col("row") * (1 << 14) + F.col("col")
    return out.join(number, "sheet").withColumn("ord", place).drop("sheet", "col", "no")


def upload(spark: SparkSession, data: bytes, category: str, filename: str, known: list[str]) -> DataFrame:
    """The records of one workbook sent as bytes; refuses unknown categories, other files, and workbooks without records."""
    if category not in known:
        raise ValueError(f"unknown category: {category}")
    if not filename.lower().endswith((".xlsx", ".xls")):
        raise ValueError(f"no workbook: {filename}")
    frame = pd.DataFrame({"path": [f"{category}/{filename}"], "content": [data]})
    rows = [tuple(r) for part in _cells(iter([frame])) for r in part.itertuples(index=False)]
    found = records(spark.createDataFrame(rows, CELLS))
    if found.isEmpty():
        raise ValueError(f"no records in {filename}")
    return found
