"""Scans of observations, and which period of a year counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import period_key


def scan(obs: DataFrame, indicator=None, district=None, level: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Rows of an indicator, a district or a level (national, districts) and years; 0 leaves a year open."""
    if indicator is not None:
        obs = obs.where(F.col("indicator_id") == indicator)
    if district is not None:
        obs = obs.where(F.col("district_id") == district)
    if level == "national":
        obs = obs.where(F.col("district_id").isNull())
    if level == "districts":
        obs = obs.where(F.col("district_id").isNotNull())
    if year_from:
        obs = obs.where(F.col("year") >= year_from)
    if year_to:
        obs = obs.where(F.col("year") <= year_to)
    return obs


def spans(obs: DataFrame, *keys: str) -> DataFrame:
    """The distinct years and periods that there are, of each of the keys if any are given."""
    return obs.select(*keys, "year", "period", "period_no").distinct()


def best_period(obs: DataFrame, *keys: str) -> DataFrame:
    """The widest period of each group: keys, period, period_no."""
    key = period_key(F.col("period"), F.col("period_no"))
    best = obs.groupBy(*keys).agg(F.max(F.struct(key.alias("key"), "period", "period_no")).alias("best"))
    return best.select(*keys, "best.period", "best.period_no")


def cells_of(obs: DataFrame) -> DataFrame:
    """One row for each indicator, district, year and period, values added up.

    All that is said of series and map layers follows from these few rows, so facts are read
    and shuffled once, after adding up within each task.
    """
    return obs.groupBy("indicator_id", "district_id", "year", "period", "period_no").agg(F.sum("value").alias("value"))


def of_best_period(cells: DataFrame, *keys: str, strict: bool = True) -> DataFrame:
    """The rows of their group's best period: of the same kind and number, or of its kind only."""
    key = period_key(F.col("period"), F.col("period_no"))
    best = F.max(F.struct(key.alias("key"), "period", "period_no")).over(Window.partitionBy(*keys))
    rows = cells.withColumn("best", best).where(F.col("period") == F.col("best.period"))
    if strict:
        rows = rows.where(F.col("period_no").eqNullSafe(F.col("best.period_no")))
    return rows.drop("best")


def available_years(obs: DataFrame) -> DataFrame:
    return obs.select("year").distinct().orderBy("year")


def latest_year(obs: DataFrame, *keys: str) -> DataFrame:
    """The last year with rows, 0 without any."""
    return obs.groupBy(*keys).agg(F.coalesce(F.max("year"), F.lit(0)).alias("latest_year"))


def counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("indicator_id").agg(F.count("*").alias("observations"))


def values_by_district(obs: DataFrame, year: int, strict: bool = False) -> DataFrame:
    """indicator_id, district_id, value, period, period_no of a year.

    The year's best period is chosen over all rows of the indicator.  As published, all rows
    of its kind are added up; ``strict`` takes only those of its number too.
    """
    of_year = obs.where(F.col("year") == year)
    best = best_period(of_year, "indicator_id")
    rows = of_best_period(of_year, "indicator_id", strict=strict).where("district_id is not null")
    sums = rows.groupBy("indicator_id", "district_id").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    return sums.join(best, "indicator_id")
