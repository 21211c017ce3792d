"""Charts as rows: kind, title, unit, and points as arrays of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .map_layer import fastest, to_mean, top_ranked


def _points(rows: DataFrame, key: str, order, **fields) -> DataFrame:
    point = F.struct(order.alias("place"), *[e.alias(n) for n, e in fields.items()])
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: p.dropFields("place")).alias("points"))


def _chart(points: DataFrame, kind: str) -> DataFrame:
    return points.select("*", F.lit(kind).alias("kind"))


def dynamics(series: DataFrame) -> DataFrame:
    """A line for each indicator with at least two points."""
    rows = _points(series, "indicator_id", F.col("year"), label=F.col("label"), value=F.col("value"), yoy=F.col("yoy"))
    return _chart(rows.where(F.size("points") >= 2), "line")


def ranking(layer: DataFrame, n: int = 17) -> DataFrame:
    return _chart(_points(top_ranked(layer, n), "indicator_id", F.col("rank"), label=F.col("name"), value=F.col("value")), "bar")


def growth(layer: DataFrame, n: int = 17) -> DataFrame:
    return _chart(_points(fastest(layer, n), "indicator_id", F.col("place"), label=F.col("name"), value=F.col("yoy")), "diverging")


def share(profile: DataFrame) -> DataFrame:
    """A district's indicators by share, largest first."""
    rows = profile.where("share is not null")
    return _chart(_points(rows, "district_id", -F.col("share"), label=F.col("indicator_id"), value=F.col("share")), "donut")


def structure(cards: DataFrame) -> DataFrame:
    """All cards of a year by growth, largest first."""
    rows = cards.where("yoy is not null")
    return _chart(_points(rows, "year", -F.col("yoy"), label=F.col("indicator_id"), value=F.col("yoy")), "diverging")


def compare(layer: DataFrame, district) -> DataFrame:
    """A district beside the mean of all districts, for each indicator."""
    rows = to_mean(layer).where((F.col("district_id") == district) & F.col("value").isNotNull())
    return _chart(_points(rows, "district_id", F.col("indicator_id"), label=F.col("indicator_id"), local=F.col("value"), republic=F.col("mean")), "dumbbell")
