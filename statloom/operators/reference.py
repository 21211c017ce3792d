"""Fixed dimensions, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORIES, DISTRICTS, MODULES
from .load import upsert


def districts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTRICTS, "district_id string, name string, name_ru string, center string, area_km2 int, population double")


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MODULES.items()], "id string, name string, short string, color string, sort int")


def categories(spark: SparkSession) -> DataFrame:
    """One row for each category; folders of the same category share it."""
    rows = spark.createDataFrame([(k, *v) for k, v in CATEGORIES.items()], "folder string, id string, name string, name_uz string, color string, sort int")
    return rows.groupBy("id", "name", "name_uz", "color", "sort").agg(F.sort_array(F.collect_list("folder")).alias("folders"))


def seeded(old: DataFrame, fixed: DataFrame, key: str) -> DataFrame:
    """The fixed rows as they should be, and others as they are."""
    return upsert(old, fixed.select(*old.columns), key)


def without_legacy(rows: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Rows (modules, or tasks by module) that don't belong to legacy ids."""
    return rows.join(legacy.select(F.col("id").alias(key)), key, "left_anti")


def catalogue_text(primary: DataFrame) -> DataFrame:
    """One text that lists modules with their primary indicator and unit, for prompts."""
    line = F.concat_ws(" | ", "module", "name", "unit")
    lines = F.array_sort(F.collect_list(F.struct("module", line.alias("line"))))
    return primary.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def district_text(districts: DataFrame) -> DataFrame:
    """One text that lists districts with their ids, for prompts; districts are a fixed list."""
    lines = F.array_sort(F.collect_list(F.struct("district_id", F.concat_ws(" | ", "district_id", "name").alias("line"))))
    return districts.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
