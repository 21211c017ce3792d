"""Plan against actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import completion_status, double, percent

STATUSES = ["completed", "in_progress", "at_risk", "critical"]


def _mean(value: Column) -> Column:
    """Mean by exact sums: null without values."""
    return double(F.sum(value)) / F.nullif(F.count(value), F.lit(0))


def summary_by_module(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean plan and actual without zeros and nulls; percent is 0 without a plan."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.coalesce(_mean(some("planned")), F.lit(0.0)).alias("plan"), F.coalesce(_mean(some("actual")), F.lit(0.0)).alias("fact"),
        F.count_if(F.col("status").isin("critical", "at_risk")).alias("critical"),
    )
    return out.withColumn("percent", F.coalesce(percent(F.col("fact"), F.col("plan")), F.lit(0.0)))


def completion(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean plan and actual without nulls, zeros kept; groups need both; null keys are left out."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    out = rows.groupBy(*keys).agg(
        _mean(F.col("planned")).alias("plan"), _mean(F.col("actual")).alias("fact"), F.count("planned").alias("p"), F.count("actual").alias("a")
    )
    out = out.where("p > 0 and a > 0").drop("p", "a")
    out = out.withColumn("completion", F.coalesce(percent(F.col("fact"), F.col("plan")), F.lit(0.0)))
    return out.withColumn("status", completion_status(F.col("completion")))


def critical(done: DataFrame, *keys: str, below: float = 80.0, n: int = 10) -> DataFrame:
    """The groups least complete, below a limit."""
    return done.where(F.col("completion") < below).orderBy("completion", *keys).limit(n)


def status_counts(rows: DataFrame) -> DataFrame:
    """One row with the count of each known status, zeros kept."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def status_histogram(rows: DataFrame) -> DataFrame:
    """Count of each status and of all."""
    every = rows.agg(F.lit("all").alias("status"), F.count("*").alias("n"))
    return rows.groupBy("status").agg(F.count("*").alias("n")).unionByName(every)


def plan_rows(plans: DataFrame, **equal) -> DataFrame:
    """Plans with these column values (module, region, year, status)."""
    for column, value in equal.items():
        if value is not None:
            plans = plans.where(F.col(column) == value)
    return plans
