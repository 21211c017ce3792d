"""Tasks: lists, status from progress, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import days_left, progress_status


def task_list(tasks: DataFrame, **equal) -> DataFrame:
    """Tasks with these column values, by deadline, then id."""
    for column, value in equal.items():
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    return tasks.orderBy("deadline", "id")


def with_days_left(tasks: DataFrame, as_of: Column) -> DataFrame:
    left = days_left(F.col("deadline"), as_of)
    return tasks.withColumn("days_left", left).withColumn("overdue", (left < 0) & (F.col("status") != "completed"))


def edited(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks with edits (id, status, progress; null leaves a value).

    A status sent along counts; else it follows from progress if that was sent.
    """
    new = changes.select("id", F.col("status").alias("_status"), F.col("progress").alias("_progress"))
    rows = tasks.join(new, "id", "left")
    derived = F.when(F.col("_progress").isNotNull(), progress_status(F.col("_progress")))
    return (
        rows.withColumn("status", F.coalesce("_status", derived, "status"))
        .withColumn("progress", F.coalesce("_progress", "progress"))
        .drop("_status", "_progress")
    )


def seeded(spark, districts: DataFrame, templates: DataFrame, year: int = 2026) -> DataFrame:
    """One task for each template (ord, title, module): district, progress and deadline follow from its place."""
    places = districts.selectExpr("district_id", "row_number() over (order by district_id) - 1 as place")
    i = F.col("ord")
    rows = templates.withColumn("place", (i * 5) % 17).withColumn("progress", ((i * 17 + 10) % 100).cast("int"))
    return rows.join(F.broadcast(places), "place").select(  # a fixed list of districts
        (i + 1).alias("id"), "title", "district_id", F.col("module").alias("module_id"), "progress", progress_status(F.col("progress")).alias("status"),
        F.make_date(F.lit(year), (1 + i % 12).cast("int"), F.lit(28)).alias("deadline"),
    )


def seeded_if_empty(tasks: DataFrame, spark, districts: DataFrame, templates: DataFrame) -> DataFrame:
    """The tasks as they are, or those of the templates where there are none."""
    return seeded(spark, districts, templates).select(*tasks.columns) if tasks.isEmpty() else tasks
