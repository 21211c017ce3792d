"""Forecasts from a piecewise-linear trend with changepoints, times a seasonal wave.

The trend's slope may change at candidate changepoints spread over the first part of a series;
the changes have a Laplace prior, so that most stay at nothing.  Seasonality is a Fourier series
that multiplies the trend.  Coefficients are those of the highest posterior density: the Laplace
prior is met by reweighted least squares, trend and season in turns; the noise is what is left
over the degrees of freedom that the changes leave, so that few values do not pass for exact.  Bounds come from
simulated futures: coefficients are drawn again around their fit, and from the last candidate on
the slope changes as often and by as much as it did.

Spark fits series side by side: a task gets one row for each time of a series, as values of
equal time are averaged before rows are brought together.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import double

CANDIDATES = 25
SHARE = 0.8  # of the history that may hold changepoints
PRIOR = 0.3  # scale of the changes of slope
DRAWS = 1000
LEAST = 3


@dataclass
class Fit:
    start: float  # the first time, and the length of the history
    span: float
    scale: float
    points: np.ndarray  # changepoints, as shares of the history
    trend: np.ndarray  # level, slope, changes of slope
    season: np.ndarray
    sigma: float
    doubt: np.ndarray  # covariance of the trend's coefficients

    def parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trend, 1 + season) at some times, scaled."""
        t = (at - self.start) / self.span
        return _ramps(t, self.points) @ self.trend, 1 + waves(at, len(self.season) // 2) @ self.season

    def ahead(self, at: np.ndarray, level: float, draws: int, seed: int) -> tuple[np.ndarray, ...]:
        """(trend, middle, lower, upper) at times after the history."""
        trend, season = self.parts(at)
        t = (at - self.start) / self.span
        last = self.points[-1] if len(self.points) else 1.0  # changes since then have not been seen
        rng = np.random.default_rng(seed)
        count = rng.poisson(len(self.points) * max(t.max() - last, 0), draws)
        path = np.repeat(np.arange(draws), count)
        where = last + rng.uniform(size=len(path)) * (t.max() - last)
        change = rng.laplace(0, _typical(self.trend), len(path))
        paths = trend + rng.multivariate_normal(np.zeros(len(self.doubt)), self.doubt, draws, method="eigh") @ _ramps(t, self.points).T
        np.add.at(paths, path, change[:, None] * np.maximum(t[None] - where[:, None], 0))
        paths = paths * season + rng.normal(0, self.sigma, paths.shape)
        low, high = np.percentile(paths, ((1 - level) * 50, (1 + level) * 50), axis=0)
        return tuple(self.scale * x for x in (trend, trend * season, low, high))


def _typical(trend: np.ndarray) -> float:
    """The mean size of the changes of slope."""
    return float(np.abs(trend[2:]).mean()) + 1e-8 if len(trend) > 2 else 1e-8


def waves(at: np.ndarray, order: int) -> np.ndarray:
    """Sines and cosines of 1 to ``order`` turns a year."""
    turns = 2 * np.pi * np.outer(at, np.arange(1, order + 1))
    return np.c_[np.sin(turns), np.cos(turns)]


def _ramps(t: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(t)), t, np.maximum(t[:, None] - points[None], 0)]


def _candidates(t: np.ndarray, most: int) -> np.ndarray:
    early = int(len(t) * SHARE)
    return t[np.unique(np.linspace(0, early - 1, min(most, max(0, early - 1)) + 1).round().astype(int))[1:]]


def fitted(at: np.ndarray, y: np.ndarray, order: int = 0, prior: float = PRIOR, candidates: int = CANDIDATES, turns: int = 25) -> Fit:
    """The model of one series, in order of time, of at least ``LEAST`` values."""
    span, scale = max(float(at[-1] - at[0]), 1e-9), float(np.abs(y).max()) or 1.0
    t, z = (at - at[0]) / span, y / scale
    points, x = _candidates(t, candidates), waves(at, order)
    ramps, season, variance = _ramps(t, points), np.zeros(2 * order), 0.01
    trend = np.linalg.lstsq(ramps[:, :2], z, rcond=None)[0]
    trend = np.r_[trend, np.full(len(points), 0.01)]
    for _ in range(turns):
        wave = 1 + x @ season
        own = ramps * wave[:, None]
        gram, right = own.T @ own, own.T @ z
        for _ in range(20):  # |change| as a square over its last size
            ridge = np.r_[1 / 25, 1 / 25, 1 / (prior * (np.abs(trend[2:]) + 1e-9))]
            trend = np.linalg.solve(gram + variance * np.diag(ridge), right)
        if order:
            line = ramps @ trend
            own = x * line[:, None]
            season = np.linalg.solve(own.T @ own + variance / 100 * np.eye(2 * order), own.T @ (z - line))
        rest = z - ramps @ trend * (1 + x @ season)
        spent = np.trace(np.linalg.solve(gram + variance * np.diag(ridge), gram)) + 2 * order
        variance = max(float(rest @ rest) / max(len(z) - spent, 1.0), 1e-10)
    loose = np.r_[1 / 25, 1 / 25, np.full(len(points), 1 / (2 * max(_typical(trend), 1e-4) ** 2))]
    doubt = variance * np.linalg.inv(gram + variance * np.diag(loose))
    return Fit(float(at[0]), span, scale, points, trend, season, float(np.sqrt(variance)), (doubt + doubt.T) / 2)


def forecast(
    rows: DataFrame, key: str, at: str, value: str, steps: int, step: float = 1.0, order: int = 0, prior: float = PRIOR, candidates: int = CANDIDATES, level: float = 0.9, draws: int = DRAWS,
) -> DataFrame:
    """(key, at, trend, yhat, lower, upper, future): every series over its own times, without bounds, and ``steps`` beyond, with them.

    ``at`` is a time in years; nulls are left out; series with fewer than three times give nothing.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        past, y = pdf["at"].to_numpy(float), pdf["y"].to_numpy(float)
        names = [key, "at", "trend", "yhat", "lower", "upper", "future"]
        if len(past) < LEAST:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        model = fitted(past, y, order, prior, candidates)
        trend, season = model.parts(past)
        ahead = past[-1] + step * np.arange(1, steps + 1)
        future = model.ahead(ahead, level, draws, zlib.crc32(str(pdf[key].iloc[0]).encode())) if steps else [np.empty(0)] * 4
        none = np.full(len(past), np.nan)
        columns = zip((model.scale * trend, model.scale * trend * season, none, none), future, strict=True)
        out = pd.DataFrame({n: np.r_[a, b] for n, (a, b) in zip(names[2:6], columns, strict=True)})
        out.insert(0, "at", np.r_[past, ahead])
        out.insert(0, key, pd.Series([pdf[key].iloc[0]] * len(out), dtype=object))
        return out.assign(future=np.r_[np.zeros(len(past), bool), np.ones(steps, bool)])

    y = double(F.col(value))
    known = rows.where(y.isNotNull() & ~F.isnan(y) & F.col(at).isNotNull()).groupBy(key, double(F.col(at)).alias("at")).agg(F.avg(y).alias("y"))
    kind = rows.schema[key].dataType.simpleString()
    found = known.groupBy(key).applyInPandas(fit, f"{key} {kind}, at double, trend double, yhat double, lower double, upper double, future boolean")
    bound = lambda c: F.when(F.col("future"), F.col(c)).alias(c)
    return found.select(key, "at", "trend", "yhat", bound("lower"), bound("upper"), "future")


def yearly_forecast(panel: DataFrame, key: str, value: str, steps: int, prior: float = PRIOR, candidates: int = CANDIDATES) -> DataFrame:
    """(key, year, yhat, lower, upper) of the years after each key's last."""
    found = forecast(panel, key, "year", value, steps, prior=prior, candidates=candidates).where("future")
    return found.select(key, F.round("at").cast("int").alias("year"), "yhat", "lower", "upper")


def yearly_trend(panel: DataFrame, key: str, value: str, steps: int) -> DataFrame:
    """(key, year, trend, yhat, future) of the years of each key and those after."""
    found = forecast(panel, key, "year", value, steps)
    return found.select(key, F.round("at").cast("int").alias("year"), "trend", "yhat", "future")


def quarterly_forecast(rows: DataFrame, key: str, value: str, steps: int = 12, order: int = 2) -> DataFrame:
    """(key, year, quarter, yhat, lower, upper) of the next quarters of each key, from (key, year, quarter, value)."""
    middle = F.col("year") + (F.col("quarter") - 0.5) / 4
    found = forecast(rows.withColumn("at", middle), key, "at", value, steps, 0.25, order).where("future")
    place = F.round(F.col("at") * 4 - 0.5).cast("int")
    return found.select(key, F.floor(place / 4).cast("int").alias("year"), (F.pmod(place, F.lit(4)) + 1).cast("int").alias("quarter"), "yhat", "lower", "upper")
