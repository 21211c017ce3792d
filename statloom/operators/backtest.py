"""Rolling-origin evaluation: every series is forecast from several years by several configurations, in one grouped job.

A row of the grid is a series, a configuration and an origin; its fit sees the years up to the
origin and is held against the years after.  Grid rows are spread by Spark; a group has one row
for each year of a series, as values of equal year are averaged first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import double
from . import changepoints, recurrent
from .models import best_configuration, ensemble, measures


@dataclass(frozen=True)
class Configuration:
    """A model by name, with its parameters."""

    name: str
    model: str
    settings: dict = field(default_factory=dict)


def _last(years: np.ndarray, values: np.ndarray, ahead: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    return np.full(len(ahead), values[-1, 0])


def _drift(years: np.ndarray, values: np.ndarray, ahead: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    slope = (values[-1, 0] - values[0, 0]) / (years[-1] - years[0])
    return values[-1, 0] + slope * (ahead - years[-1])


def _line(years: np.ndarray, values: np.ndarray, ahead: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    middle = years.mean()
    slope = ((years - middle) * (values[:, 0] - values[:, 0].mean())).sum() / ((years - middle) ** 2).sum()
    return values[:, 0].mean() + slope * (ahead - middle)


def _changepoints(years: np.ndarray, values: np.ndarray, ahead: np.ndarray, known: np.ndarray, seed: int, **settings) -> np.ndarray | None:
    if len(years) < changepoints.LEAST:
        return None
    fit = changepoints.fitted(years, values[:, 0], **settings)
    trend, season = fit.parts(ahead)
    return fit.scale * trend * season


def _recurrent(years: np.ndarray, values: np.ndarray, ahead: np.ndarray, known: np.ndarray, seed: int, window=recurrent.WINDOW, units=recurrent.UNITS, dropout=recurrent.DROPOUT, epochs=recurrent.EPOCHS, draws=recurrent.DRAWS) -> np.ndarray | None:
    found = recurrent.predicted(values, known, window, units, dropout, epochs, draws, seed)
    return None if found is None else found[0]


#: Each takes years, values (the target first), the years ahead, the inputs of these, a seed and its settings.
MODELS: dict[str, Callable[..., np.ndarray | None]] = {"last": _last, "drift": _drift, "line": _line, "changepoints": _changepoints, "recurrent": _recurrent}
CLOSED = tuple(Configuration(name, name) for name in ("last", "drift", "line"))
#: Widths of window, units and dropout that are tried.
GRID = tuple(Configuration(f"w{w}-{u}", "recurrent", {"window": w, "units": u, "dropout": d}) for w, u, d in ((3, 16, 0.2), (4, 16, 0.2), (3, 8, 0.1)))


def backtested(panel: DataFrame, key: str, value: str, configurations: tuple[Configuration, ...] = CLOSED, origins: tuple[int, ...] = (), horizon: int = 1, inputs: tuple[str, ...] = ()) -> DataFrame:
    """(key, configuration, origin, year, yhat, actual) of the years after each origin that have a value.

    Inputs of the years ahead are known.  A fit needs two years at least, or what its model needs;
    one that fails gives no rows.
    """
    names = [value, *inputs]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        who, name, origin = pdf[key].iloc[0], pdf["configuration"].iloc[0], int(pdf["origin"].iloc[0])
        pdf = pdf.dropna(subset=names).sort_values("year")
        past, test = pdf[pdf["year"] <= origin], pdf[pdf["year"] > origin]
        chosen = next(c for c in configurations if c.name == name)
        found = None
        if len(past) >= 2 and len(test):
            seed = zlib.crc32(f"{who}|{name}|{origin}".encode())
            found = MODELS[chosen.model](past["year"].to_numpy(float), past[names].to_numpy(float), test["year"].to_numpy(float), test[list(inputs)].to_numpy(float), seed, **chosen.settings)
        test = test if found is not None else test.iloc[:0]
        whose, which = (pd.Series([x] * len(test), dtype=object) for x in (who, name))
        out = {key: whose, "configuration": which, "origin": np.full(len(test), origin, np.int32), "year": test["year"].to_numpy(np.int32)}
        return pd.DataFrame(out | {"yhat": found if found is not None else np.empty(0), "actual": test[value].to_numpy(float)})

    year = F.col("year").cast("int").alias("year")
    rows = panel.groupBy(key, year).agg(*[F.avg(double(F.col(c))).alias(c) for c in names])
    each = [F.struct(F.lit(c.name).alias("configuration"), F.lit(int(o)).alias("origin")) for c in configurations for o in origins]
    grid = rows.select("*", F.inline(F.array(*each))).where(F.col("year") <= F.col("origin") + horizon)
    kind = panel.schema[key].dataType.simpleString()
    return grid.groupBy(key, "configuration", "origin").applyInPandas(fit, f"{key} {kind}, configuration string, origin int, year int, yhat double, actual double")


def scores(found: DataFrame, key: str) -> DataFrame:
    """Measures of each series and configuration over all origins and years."""
    none = F.lit(None).cast("double")
    return measures(found.withColumn("lower", none).withColumn("upper", none), key, "configuration").drop("coverage")


def chosen(panel: DataFrame, key: str, value: str, configurations: tuple[Configuration, ...] = CLOSED, origins: tuple[int, ...] = (), horizon: int = 1, inputs: tuple[str, ...] = ()) -> DataFrame:
    """(key, configuration, mape): the configuration of each series with the least error on the years held out; errors equal to nine digits tie, the first name wins."""
    found = scores(backtested(panel, key, value, configurations, origins, horizon, inputs), key).withColumn("mape", F.round("mape", 9))
    return best_configuration(found.where(F.col("mape").isNotNull()), key)


def weighted(panel: DataFrame, key: str, value: str, forecasts: dict[str, DataFrame], configurations: tuple[Configuration, ...], origins: tuple[int, ...], horizon: int = 1, inputs: tuple[str, ...] = ()) -> DataFrame:
    """(key, year, yhat, lower, upper): forecasts by configuration, weighted by the inverse of their error on the years held out.

    A configuration without an error counts as if it were wholly off (100 percent).
    """
    errors = scores(backtested(panel, key, value, configurations, origins, horizon, inputs), key).select(key, "configuration", "mape")
    parts = [df.select(key, "year", F.lit(name).alias("configuration"), F.explode(F.create_map(*[x for c in ("yhat", "lower", "upper") for x in (F.lit(c), F.col(c))])).alias("bound", "part")) for name, df in forecasts.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rows = every.join(errors, [key, "configuration"], "left").select(key, "year", "bound", F.col("part").alias("yhat"), F.coalesce("mape", F.lit(100.0)).alias("mape"))
    both = ensemble(rows, key, "year", "bound")
    return both.groupBy(key, "year").agg(*[F.max(F.when(F.col("bound") == c, F.col("yhat"))).alias(c) for c in ("yhat", "lower", "upper")])
