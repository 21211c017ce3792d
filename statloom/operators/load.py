"""Loading parsed records into indicators and observations.

Records have category, indicator, unit, district_id, year, period, period_no, value,
source, row, block and ord, the order in which they were read.  Where the first of several
counts, it is the first by ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..constants import CORE_MODULES, LOWER_IS_BETTER
from ..functions.text import contains_any, core_module
from ..lineage import cut, numbered

KEY = ["indicator_id", "district_id", "year", "period", "period_no"]


def keep_known(records: DataFrame, categories: list[str]) -> DataFrame:
    return records.where(F.col("category").isin(categories))


def record_key() -> Column:
    """What tells indicators apart: name and unit, later blocks also by source; national rows by source and row."""
    later = F.when(F.col("block") > 0, F.concat_ws("|", F.lit(""), "source", F.col("block").cast("string"))).otherwise("")
    district = F.concat(F.concat_ws("|", "indicator", "unit"), later)
    national = F.concat_ws("|", "indicator", "source", F.col("row").cast("string"))
    return F.when(F.col("district_id").isNotNull(), district).otherwise(national)


def indicators_of(records: DataFrame, key: str, needles: list[tuple[str, str]] = CORE_MODULES) -> DataFrame:
    """One indicator for each key: attributes of its first record, first unit that isn't empty."""
    first = F.min_by(F.struct(F.substring("indicator", 1, 300).alias("name"), "category", F.substring("source", 1, 200).alias("source")), "ord")
    unit = F.min_by(F.when(F.col("unit") != "", F.substring("unit", 1, 80)), F.when(F.col("unit") != "", F.col("ord")))
    rows = records.groupBy(key).agg(first.alias("a"), F.coalesce(unit, F.lit("")).alias("unit"), F.bool_or(F.col("district_id").isNotNull()).alias("has_districts"))
    return rows.select(
        key, "a.*", "unit", "has_districts", core_module(F.col("a.name"), needles).alias("module"), contains_any(F.col("a.name"), LOWER_IS_BETTER).alias("lower_is_better")
    )


def with_ids(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Known keys keep their id, others get the next ones by key."""
    known = old.select(key, F.col("id").alias("_old"))
    rows = new.join(known, key, "left")
    last = old.agg(F.max("id")).first()[0] or 0
    fresh = numbered(rows.where("_old is null").select(key).distinct(), "_n", key)
    rows = rows.join(fresh, key, "left")
    return rows.withColumn("id", F.coalesce("_old", F.lit(last) + F.col("_n"))).drop("_old", "_n")


def first_of_each(observations: DataFrame, *key: str) -> DataFrame:
    """The first row by ord of each key, nulls equal; no order decides among equal ord."""
    first = Window.partitionBy(*(key or KEY)).orderBy("ord")
    return observations.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def known_districts(observations: DataFrame, districts: DataFrame) -> DataFrame:
    """National rows and those of known districts."""
    known = districts.select(F.col("district_id").alias("_known"))
    kept = observations.join(known, F.col("district_id") == F.col("_known"), "left")
    return kept.where("district_id is null or _known is not null").drop("_known")


def fully_refreshed(indicators: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All old observations go; the new ones, and the indicators that have any of them."""
    return indicators.join(new.select(F.col("indicator_id").alias("id")).distinct(), "id", "left_semi"), new


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old observations of indicators that the new ones don't touch, and the new ones."""
    return old.join(new.select("indicator_id").distinct(), "indicator_id", "left_anti").unionByName(new)


def orphans(indicators: DataFrame, observations: DataFrame) -> DataFrame:
    """Indicators without observations."""
    return indicators.join(observations, indicators["id"] == observations["indicator_id"], "left_anti")


def load_statistics(records: DataFrame, districts: DataFrame, key: str) -> DataFrame:
    """One row: categories, indicators, rows added and rows passed over."""
    kept = first_of_each(known_districts(records, districts), key, "district_id", "year", "period", "period_no")
    return kept.agg(F.count("*").alias("added"), F.count_distinct(key).alias("indicators"), F.count_distinct("category").alias("categories")).crossJoin(
        records.agg(F.count("*").alias("read"))  # one row each
    ).withColumn("skipped", F.col("read") - F.col("added")).drop("read")


def load(records: DataFrame, districts: DataFrame, indicators: DataFrame, observations: DataFrame, key: str, to: str, replace_all: bool = False) -> dict[str, int]:
    """Loads records into ``to``/indicators and ``to``/observations (another folder than that of the old tables), and says what was done.

    Old tables are (``key``, id, name, ...) and (indicator_id, district_id, year, period, period_no,
    value).  With ``replace_all`` all old observations go, and indicators that are left without
    any; otherwise only those of the indicators that the records touch.  Counted as the rows are
    written: categories and indicators of the records, rows ``added``, rows ``skipped`` (of unknown
    districts, or not the first of their key), and ``orphans`` removed.  Without records nothing
    is written and all counts are 0; without districts nothing can be loaded.
    """
    if records.isEmpty():
        return dict.fromkeys(("categories", "indicators", "added", "skipped", "orphans"), 0)
    if districts.isEmpty():
        raise ValueError("no districts")
    read, kept, made = Observation("read"), Observation("kept"), Observation("made")
    known = districts.select(F.col("district_id").alias("_known"))
    rows = records.join(known, F.col("district_id") == F.col("_known"), "left").withColumn("_fits", F.col("district_id").isNull() | F.col("_known").isNotNull()).drop("_known")
    touched = indicators_of(rows, key).join(rows.groupBy(key).agg(F.bool_or("_fits").alias("_held")), key)
    numbered_ones = cut(with_ids(touched, indicators, key))
    old = indicators.join(numbered_ones.select(key), key, "left_anti")
    still = F.lit(False)
    if not replace_all:
        still = F.lit(True)  # they keep what they have
    every = numbered_ones.withColumn("_touched", F.lit(True)).unionByName(old.withColumn("_held", still).withColumn("_touched", F.lit(False)), allowMissingColumns=True)
    every = every.observe(made, F.count_if("_touched").alias("indicators"), F.count_if(~F.col("_held")).alias("without"))
    every = every.where("_held") if replace_all else every
    every.drop("_held", "_touched").write.mode("overwrite").parquet(f"{to}/indicators")

    ids = numbered_ones.select(key, F.col("id").alias("indicator_id"))
    counted = rows.observe(read, F.count("*").alias("read"), F.size(F.collect_set("category")).alias("categories"))  # as many as there are folders
    first = Window.partitionBy(key, "district_id", "year", "period", "period_no").orderBy("ord")
    new = counted.where("_fits").withColumn("_n", F.row_number().over(first)).where("_n = 1").observe(kept, F.count("*").alias("added"))
    new = new.join(ids, key).select(*KEY, "value")
    if not replace_all:
        new = observations.select(*KEY, "value").join(ids.select("indicator_id"), "indicator_id", "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{to}/observations")
    added = kept.get["added"]
    return {
        "categories": read.get["categories"], "indicators": made.get["indicators"], "added": added, "skipped": read.get["read"] - added,
        "orphans": made.get["without"] if replace_all else 0,
    }


def redirected(indicators: DataFrame, ident, lower_is_better: bool) -> DataFrame:
    """An indicator told anew whether lower is better."""
    own = F.when(F.col("id") == ident, F.lit(lower_is_better)).otherwise(F.col("lower_is_better"))
    return indicators.withColumn("lower_is_better", own)


def rebound(indicators: DataFrame, ident, module: str | None, modules: list[str]) -> DataFrame:
    """An indicator bound to another module; only known modules, only indicators with districts."""
    if module is not None and module not in modules:
        raise ValueError(f"unknown module: {module}")
    here = (F.col("id") == ident) & F.col("has_districts")
    return indicators.withColumn("module", F.when(here, F.lit(module)).otherwise(F.col("module")))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows, and old ones whose key is not among them."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def without(rows: DataFrame, key: str, *gone) -> DataFrame:
    """The rows but those with one of these keys."""
    return rows.where(F.col(key).isNull() | ~F.col(key).isin(*gone))
