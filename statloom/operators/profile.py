"""A district's profile and the overview of all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent, severity
from ..lineage import cut
from .map_layer import extremes, map_layer
from .observations import cells_of
from .series import district_series, national_series


def trend(points: DataFrame, *keys: str, n: int, value: str = "value") -> DataFrame:
    """The last n points of each group as an array of (year, value), oldest first."""
    last = Window.partitionBy(*keys).orderBy(F.desc("year"))
    rows = points.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", F.col(value).alias("value")))).alias("trend"))


def district_profile(obs: DataFrame, districts: DataFrame, district, year: int, points: int = 8) -> DataFrame:
    """A row for each indicator that the district has in the year: value, growth, share, rank, trend."""
    obs = cut(cells_of(obs))
    own = cut(district_series(obs.where(F.col("district_id") == district)))
    layer = cut(map_layer(obs, districts, year))
    ranked = layer.where(F.col("district_id") == district).select("indicator_id", "rank", "total")
    of = layer.where("value is not null").groupBy("indicator_id").agg(F.count("*").alias("of"))
    now = own.where(F.col("year") == year)
    return now.join(ranked, "indicator_id", "left").join(of, "indicator_id", "left").join(
        trend(own, "indicator_id", n=points), "indicator_id"
    ).select(
        "indicator_id", "district_id", "year", "label", "value", "yoy", percent(F.col("value"), F.col("total")).alias("share"), "rank", "of",
        severity(F.col("yoy")).alias("status"), "trend",
    )


def overview(obs: DataFrame, districts: DataFrame, year: int, points: int = 10) -> DataFrame:
    """A card for each indicator with a national point in the year: value, growth, leader, laggard, trend."""
    obs = cut(cells_of(obs))
    nation = cut(national_series(obs))
    ends = extremes(map_layer(obs, districts, year)).select("indicator_id", "leader", "laggard")
    return nation.where(F.col("year") == year).join(ends, "indicator_id", "left").join(trend(nation, "indicator_id", n=points), "indicator_id")


def growth_counts(cards: DataFrame) -> DataFrame:
    """Mean growth, null without any, and how many grow or decline."""
    return cards.agg(F.avg("yoy").alias("mean_yoy"), F.count_if(F.col("yoy") > 0).alias("growing"), F.count_if(F.col("yoy") < 0).alias("declining"))
