"""Composite reports: early warning, dashboard, annual report, forecasts; and a pipeline whose stages may fail alone."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..lineage import cut, delete, scratch
from .forecasting import DRIVERS, forecast
from .models import boosted_warning, ensemble, measures, trend_forecast, warned
from .panel import features, split_by_years
from .plan_actual import completion, critical, status_counts, summary_by_module


def weak_spots(panel: DataFrame, year: int | None = None, key: str = "district_id", fit: Callable[[DataFrame], object] = boosted_warning) -> DataFrame:
    """Districts whose rate is predicted in the worst class, most probable first; the last year unless one is given.

    Lags are taken over the whole panel, and only then the year is chosen.
    """
    ready = cut(features(panel, key))
    rows = warned(fit(ready), ready, key)
    if year is None:
        rows = rows.join(F.broadcast(rows.agg(F.max("year").alias("year"))), "year")  # one row
    else:
        rows = rows.where(F.col("year") == year)
    return rows.where("predicted = 2").orderBy(F.desc("p2"), key)


def critical_counts(warnings: DataFrame, key: str = "district_id") -> DataFrame:
    """Of each year the number of districts predicted in the worst class, and of all."""
    return warnings.groupBy("year").agg(F.count_distinct(F.when(F.col("predicted") == 2, F.col(key))).alias("critical"), F.count_distinct(key).alias("districts"))


def holdout(panel: DataFrame, key: str, value: str, years: list[int], model: Callable[..., DataFrame] = trend_forecast) -> DataFrame:
    """Measures of a model's forecast (key, year, yhat, lower, upper) for years left out of the fit."""
    past, test = split_by_years(panel, years)
    ahead = model(past, key, value, len(years))
    truth = test.select(key, F.col("year").cast("int").alias("year"), F.col(value).alias("actual"))
    return measures(ahead.join(truth, [key, "year"]), key)


def all_forecasts(forecasts: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Forecasts (keys, yhat) of several models as one table with ``model``."""
    return reduce(DataFrame.unionByName, [df.select(*keys, "yhat", F.lit(model).alias("model")) for model, df in forecasts.items()])


def weighted_forecast(forecasts: dict[str, DataFrame], errors: DataFrame, *keys: str) -> DataFrame:
    """Forecasts of several models (keys, yhat) combined by their errors (model, mape)."""
    return ensemble(all_forecasts(forecasts, *keys).join(errors, "model"), *keys)


def dashboard(plans: DataFrame, below: float = 80.0, year: int | None = None, wide: DataFrame | None = None, steps: int = 3, drivers: dict = DRIVERS) -> dict[str, DataFrame]:
    """Modules, statuses, the regions least complete and, where yearly figures are given, the forecasts of all of them."""
    plans = plans if year is None else plans.where(F.col("year") == year)
    done = completion(plans, "module", "region")
    parts = {"modules": summary_by_module(plans, "module"), "statuses": status_counts(plans), "critical": critical(done, "module", "region", below=below)}
    return parts if wide is None else parts | {"forecasts": forecast(wide, steps=steps, drivers=drivers)}


def annual_report(plans: DataFrame, year: int) -> DataFrame:
    """Completion by module of a year; no rows if it has none."""
    return completion(plans.where(F.col("year") == year), "module")


def annual_text(plans: DataFrame, years: list[int]) -> DataFrame:
    """(year, text): the completion by module of each of the years, a line a module; a message for a year without plans."""
    asked = plans.sparkSession.createDataFrame([(y,) for y in years], "year int")
    lines = completion(plans.join(F.broadcast(asked), "year"), "year", "module").where("module is not null")  # as many as are asked
    said = F.concat_ws(" | ", "module", fixed(F.col("plan")), fixed(F.col("fact")), "status")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("module", said.alias("line")))), lambda x: x["line"]), "\n")
    told = lines.groupBy("year").agg(text.alias("text"))
    return asked.join(told, "year", "left").select("year", F.coalesce("text", F.concat(F.col("year").cast("string"), F.lit("-jıl ushın maǵlıwmat joq."))).alias("text"))


def run_isolated(stages: dict[str, Callable[[], DataFrame]], seconds: float | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The rows of each stage, staged, and the errors of those that failed or took over ``seconds``; the stages run together.

    Each runs in a thread with a scheduler pool and a job tag of its own.  A failure stops no
    other stage; one that is late is cancelled by its tag, and what it has written is deleted.
    ``release`` deletes the rows of stages that are no longer needed.
    """
    spark = SparkSession.active()
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    paths = {name: scratch(spark, "stage") for name in stages}

    def run(name: str) -> None:
        spark.sparkContext.addJobTag(f"stage-{paths[name].rpartition('-')[2]}")
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            out = stages[name]()
            out.write.parquet(paths[name])
            done[name] = spark.read.schema(out.schema).parquet(paths[name])
        except Exception as error:  # noqa: BLE001  whatever a stage raises is reported, not hidden
            failed.setdefault(name, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")

    threads = {name: InheritableThread(target=run, args=(name,)) for name in stages}
    for thread in threads.values():
        thread.start()
    until = None if seconds is None else time.monotonic() + seconds
    for name, thread in threads.items():
        thread.join(None if until is None else max(0.0, until - time.monotonic()))
        if thread.is_alive():
            failed[name] = f"late: over {seconds:g} seconds"
            while thread.is_alive():  # a stage may start another job after one was cancelled
                spark.sparkContext.cancelJobsWithTag(f"stage-{paths[name].rpartition('-')[2]}")
                thread.join(0.2)
            done.pop(name, None)
    for name in failed:
        delete(spark, paths[name])
    return {name: done[name] for name in stages if name in done}, {name: failed[name] for name in stages if name in failed}


def release(done: dict[str, DataFrame]) -> None:
    """Deletes the staged rows of stages."""
    for rows in done.values():
        for path in {file.rpartition("/")[0] for file in rows.inputFiles()}:
            delete(rows.sparkSession, path)
    done.clear()
