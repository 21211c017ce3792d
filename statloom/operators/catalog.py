"""The catalogue: primary indicators, search, pages, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MODULES
from ..functions.text import is_volume, search_form
from .observations import counts


def primary_indicators(indicators: DataFrame, obs: DataFrame) -> DataFrame:
    """One indicator for each module: with districts, a volume, more observations, a smaller id."""
    n = counts(obs)
    rows = indicators.where("module is not null").join(n, indicators["id"] == n["indicator_id"], "left")
    best = Window.partitionBy("module").orderBy(
        F.desc("has_districts"), F.desc(is_volume(F.col("name"), F.col("unit"))), F.desc(F.coalesce("observations", F.lit(0))), "id"
    )
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").select(
        "module", "id", "name", "unit", F.coalesce("observations", F.lit(0)).alias("observations")
    )


def category_counts(categories: DataFrame, indicators: DataFrame, obs: DataFrame) -> DataFrame:
    """Indicators and observations of each category, zeros kept."""
    n = counts(obs)
    per_indicator = indicators.join(n, indicators["id"] == n["indicator_id"], "left")
    sums = per_indicator.groupBy("category_id").agg(F.count("id").alias("indicators"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"))
    return categories.join(sums, categories["id"] == sums["category_id"], "left").select(
        categories["id"], categories["name"], F.coalesce("indicators", F.lit(0)).alias("indicators"), F.coalesce("observations", F.lit(0)).alias("observations")
    )


def summary(indicators: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of totals."""
    a = obs.agg(
        F.count("*").alias("observations"), F.count_distinct("district_id").alias("districts"), F.coalesce(F.min("year"), F.lit(0)).alias("first_year"), F.coalesce(F.max("year"), F.lit(0)).alias("last_year")
    )
    b = indicators.agg(F.count("*").alias("indicators"), F.count_if("has_districts").alias("with_districts"))
    return a.crossJoin(b)  # one row each


def search(indicators: DataFrame, form: Column | None = None, asked: Column | None = None, category=None, module=None, has_districts: bool | None = None) -> DataFrame:
    """Indicators by category, module, level, and a part of their search form."""
    if category is not None:
        indicators = indicators.where(F.col("category_id") == category)
    if module is not None:
        indicators = indicators.where(F.col("module") == module)
    if has_districts is not None:
        indicators = indicators.where(F.col("has_districts") == has_districts)
    if asked is not None:
        indicators = indicators.where(F.contains(form, asked))
    return indicators


def page(rows: DataFrame, *order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page with the total before paging; at most 500 rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 500)).crossJoin(total)  # a page and one row


def indicator_detail(indicators: DataFrame, obs: DataFrame, ident) -> DataFrame:
    """An indicator with its observations and years."""
    own = obs.where(F.col("indicator_id") == ident).groupBy("indicator_id").agg(
        F.count("*").alias("observations"), F.count_distinct("district_id").alias("districts"), F.sort_array(F.collect_set("year")).alias("years")
    )
    return indicators.where(F.col("id") == ident).join(own, F.col("id") == F.col("indicator_id"), "left").drop("indicator_id")


def found(indicators: DataFrame, asked: str, **filters) -> DataFrame:
    """Indicators whose name holds the words asked for, both in search form."""
    return search(indicators, search_form(F.col("name")), search_form(F.lit(asked)), **filters)


def brief(indicators: DataFrame) -> DataFrame:
    """The indicators with their module's name and colour, null for unknown modules."""
    fixed = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in MODULES.items() for x in (k, v[i])]), F.col("module"))
    return indicators.select("*", fixed(0).alias("module_name"), fixed(2).alias("color"))


def module_meta(indicators: DataFrame, obs: DataFrame) -> DataFrame:
    """Each known module with a primary indicator: names, colour, order, unit, indicator and its years."""
    own = primary_indicators(indicators, obs).select("module", F.col("id").alias("indicator_id"), "unit")
    years = obs.join(own.select("indicator_id"), "indicator_id").groupBy("indicator_id").agg(F.sort_array(F.collect_set("year")).alias("years"))
    fixed = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in MODULES.items() for x in (k, v[i])]), F.col("module"))
    rows = own.join(years, "indicator_id", "left").where(F.col("module").isin(*MODULES))
    return rows.select("module", fixed(0).alias("name"), fixed(1).alias("short"), fixed(2).alias("color"), fixed(3).alias("sort"), "unit", "indicator_id", "years", F.try_element_at("years", F.lit(-1)).alias("latest_year"))


def meta(indicators: DataFrame, obs: DataFrame, categories: DataFrame, districts: DataFrame) -> DataFrame:
    """One row: years, modules, categories and districts as arrays, and the totals; each array is of a fixed list."""
    gathered = lambda df, name, order: df.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), *df.columns))).alias(name))
    parts = [
        obs.agg(F.sort_array(F.collect_set("year")).alias("years")),
        gathered(module_meta(indicators, obs), "modules", "sort"),
        gathered(category_counts(categories, indicators, obs), "categories", "id"),
        gathered(districts, "districts", "name"),
        summary(indicators, obs).select("observations", "indicators", F.col("districts").alias("n_districts")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def page_counts(rows: DataFrame, per_page: int, *keys: str) -> DataFrame:
    """How many pages the rows of each key take."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / per_page).alias("pages"))
