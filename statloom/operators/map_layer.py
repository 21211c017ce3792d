"""The ranked map layer: all districts of an indicator in a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import double, growth, percent, ratio
from ..functions.period import is_partial, same_span
from ..lineage import cut, every_pair
from .observations import best_period, cells_of, of_best_period


def map_layer(obs: DataFrame, districts: DataFrame, year: int, strict: bool = False) -> DataFrame:
    """A row for each indicator with rows in the year and each district (district_id, name).

    value, share of the total and intensity to the largest; growth to the year before where
    the two years' best periods are of equal span; rank by value, then district_id, among
    districts with a value.
    """
    two = cut(cells_of(obs.where(F.col("year").isin(year - 1, year))))
    is_now = F.col("year") == year
    kept = of_best_period(two, "indicator_id", "year", strict=strict).where("district_id is not null")
    sum_of = lambda own: F.when(F.count_if(own) > 0, F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0)))
    sums = cut(kept.groupBy("indicator_id", "district_id").agg(sum_of(is_now).alias("value"), sum_of(~is_now).alias("base")))

    span = F.struct("period", "period_no")
    spans = best_period(two, "indicator_id", "year").groupBy("indicator_id").agg(F.max(F.when(is_now, span)).alias("now"), F.max(F.when(~is_now, span)).alias("then"))
    totals = sums.groupBy("indicator_id").agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.count("value").alias("n"), F.count("base").alias("bases"))
    comparable = (F.col("bases") > 0) & F.coalesce(same_span(F.col("now.period"), F.col("now.period_no"), F.col("then.period"), F.col("then.period_no")), F.lit(False))
    header = totals.where("n > 0").join(spans, "indicator_id").select("indicator_id", "now.period", "now.period_no", "total", "top", comparable.alias("comparable"))
    cells = every_pair(header, districts.select("district_id", "name"))  # every indicator lists every district
    rows = cells.join(sums, ["indicator_id", "district_id"], "left")
    order = Window.partitionBy("indicator_id", F.col("value").isNull()).orderBy(F.desc("value"), "district_id")
    return rows.select(
        "indicator_id",
        "district_id",
        "name",
        double(F.col("value")).alias("value"),
        percent(F.col("value"), F.col("total")).alias("share"),
        ratio(F.col("value"), F.col("top")).alias("intensity"),
        F.when(F.col("comparable"), growth(F.col("value"), F.col("base"))).alias("yoy"),
        F.when(F.col("value").isNotNull(), F.row_number().over(order)).alias("rank"),
        "period",
        "period_no",
        is_partial(F.col("period")).alias("partial"),
        double(F.col("total")).alias("total"),
    )


def shown(rows: DataFrame) -> DataFrame:
    """The rows as they are presented: values, totals, shares and growth to two digits, intensities to four."""
    digits = {"value": 2, "total": 2, "share": 2, "yoy": 2, "mean_yoy": 2, "intensity": 4}
    return rows.withColumns({c: F.round(c, digits[c]) for c in rows.columns if c in digits})


def top_ranked(layer: DataFrame, n: int = 17) -> DataFrame:
    """The first districts of each indicator by rank."""
    return layer.where(F.col("rank") <= n)


def _by_growth(layer: DataFrame, order, n: int) -> DataFrame:
    place = Window.partitionBy("indicator_id").orderBy(order, "district_id")
    return layer.where("yoy is not null").withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def fastest(layer: DataFrame, n: int = 17) -> DataFrame:
    return _by_growth(layer, F.desc("yoy"), n)


def slowest(layer: DataFrame, n: int = 4) -> DataFrame:
    return _by_growth(layer, F.asc("yoy"), n)


def declining(layer: DataFrame, n: int = 6) -> DataFrame:
    return _by_growth(layer.where("yoy < 0"), F.asc("yoy"), n)


def leaders_and_laggards(layer: DataFrame, n: int = 3) -> DataFrame:
    """The first and last districts by value, with ``side``."""
    last = Window.partitionBy("indicator_id").orderBy(F.asc("value"), F.desc("district_id"))
    ranked = layer.where("value is not null").withColumn("from_last", F.row_number().over(last))
    side = F.when(F.col("rank") <= n, "top").when(F.col("from_last") <= n, "bottom")
    return ranked.withColumn("side", side).where("side is not null").drop("from_last")


def extremes(layer: DataFrame) -> DataFrame:
    """leader and laggard of each indicator, and how many districts grow or decline."""
    return layer.where("value is not null").groupBy("indicator_id").agg(
        F.max_by(F.coalesce("name", "district_id"), F.struct(F.col("value"), -F.col("rank"))).alias("leader"),
        F.min_by(F.coalesce("name", "district_id"), F.struct(F.col("value"), -F.col("rank"))).alias("laggard"),
        F.count_if(F.col("yoy") > 0).alias("growing"),
        F.count_if(F.col("yoy") < 0).alias("declining"),
        F.avg("yoy").alias("mean_yoy"),
    )


def to_mean(layer: DataFrame) -> DataFrame:
    """Each district's value beside the mean of all districts with one."""
    means = layer.groupBy("indicator_id").agg(F.sum(F.col("value").cast("decimal(24,4)")).alias("s"), F.count("value").alias("n"))
    mean = double(F.col("s")) / F.nullif(F.col("n"), F.lit(0))
    return layer.join(means, "indicator_id").select("indicator_id", "district_id", "value", mean.alias("mean"))


def largest_shares(rows: DataFrame, n: int) -> DataFrame:
    """The n modules of each district with the largest shares."""
    place = Window.partitionBy("district_id").orderBy(F.desc("share"), "module")
    return rows.where("share is not null").withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def highlights(layer: DataFrame, n: int = 5) -> DataFrame:
    """The names of the first districts of each indicator, each once."""
    rows = top_ranked(layer, n).groupBy("indicator_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("r"))
    return rows.select("indicator_id", F.array_distinct(F.transform("r", lambda x: x["name"])).alias("highlights"))
