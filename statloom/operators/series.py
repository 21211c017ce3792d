"""Time series with like-for-like growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import double, growth
from ..functions.period import caption, is_partial, year_label
from .observations import cells_of, of_best_period, scan


def national_rows(obs: DataFrame) -> DataFrame:
    """Of each indicator its national rows if it has any in any year, else its district rows; with ``aggregated``."""
    has = F.bool_or(F.col("district_id").isNull()).over(Window.partitionBy("indicator_id"))
    rows = obs.withColumn("aggregated", ~has)
    return rows.where(F.col("aggregated") | F.col("district_id").isNull())


def _points(cells: DataFrame, keys: list[str]) -> DataFrame:
    kept = of_best_period(cells, *keys, "year").withColumn("place", F.col("district_id"))
    line = Window.partitionBy(*keys, "place", "period", "period_no").orderBy("year")
    base = F.when(F.lag("year").over(line) == F.col("year") - 1, F.lag("value").over(line))
    paired = kept.withColumn("base", base)
    common = F.when(F.col("base").isNotNull(), F.col("value"))
    out = paired.groupBy(*keys, "year").agg(
        F.sum("value").alias("value"),
        growth(F.sum(common), F.sum("base")).alias("yoy"),
        F.count_distinct(F.coalesce("place", F.lit(""))).alias("sources"),
        F.first("period").alias("period"),
        F.first("period_no").alias("period_no"),
        F.first("aggregated").alias("aggregated"),
    )
    return out.select(
        *keys, "year", year_label(F.col("year"), F.col("period")).alias("label"), caption(F.col("period"), F.col("period_no")).alias("caption"),
        is_partial(F.col("period")).alias("partial"), double(F.col("value")).alias("value"), "yoy", F.col("sources").cast("long").alias("sources"), "aggregated",
    )


def national_series(obs: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """A point for each indicator and year.

    Growth compares the districts present in both calendar years, for equal spans only, to
    the absolute base.  Years outside the range are gone before growth is taken, so the
    first point has none.
    """
    rows = scan(national_rows(cells_of(obs)), year_from=year_from, year_to=year_to)
    return _points(rows, ["indicator_id"])


def district_series(obs: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """A point for each indicator, district and year; the best period is the district's own."""
    rows = scan(obs, level="districts", year_from=year_from, year_to=year_to)
    return _points(cells_of(rows).withColumn("aggregated", F.lit(False)), ["indicator_id", "district_id"])
