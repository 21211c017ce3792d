"""Forecasts from a gated recurrent cell, trained on sliding windows; bounds by dropout kept on.

Inputs are logarithms scaled to 0.05..0.95.  The cell reads the steps of a window; a dense layer
makes the next value from its last state.  It is trained by back-propagation through time
(Adam, Huber loss, the last fifth of the windows kept to stop early).  Forecasts feed on
themselves; ``draws`` runs with dropout give the 5th and 95th percentile.

Spark fits series side by side, from one row for each year of a series.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import double

WINDOW, UNITS, DROPOUT, DRAWS = 3, 16, 0.2, 200
EPOCHS, PATIENCE, RATE = 400, 60, 0.01
LEAST = 4  # windows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Cell:
    """A gated recurrent cell over (rows, steps, inputs), then a dropout and a dense layer to one number."""

    def __init__(self, inputs: int, units: int, seed: int):
        rng = np.random.default_rng(seed)
        wide = lambda n, m: rng.normal(0, 1 / np.sqrt(n), (n, m))
        self.w = {g + k: v for g in "zrc" for k, v in (("x", wide(inputs, units)), ("h", wide(units, units)), ("b", np.zeros(units)))}
        self.w |= {"out": wide(units, 1), "shift": np.zeros(1)}

    def forward(self, x: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[np.ndarray, list]:
        """The outputs, and what ``backward`` needs; ``keep`` multiplies the last state."""
        w, h, past = self.w, np.zeros((len(x), self.w["zh"].shape[0])), []
        for step in range(x.shape[1]):
            now = x[:, step]
            z = _sigmoid(now @ w["zx"] + h @ w["zh"] + w["zb"])
            r = _sigmoid(now @ w["rx"] + h @ w["rh"] + w["rb"])
            c = np.tanh(now @ w["cx"] + (r * h) @ w["ch"] + w["cb"])
            past.append((now, h, z, r, c))
            h = (1 - z) * h + z * c
        return (h * keep) @ w["out"][:, 0] + w["shift"][0], [*past, h]

    def backward(self, past: list, d_out: np.ndarray, keep: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        w, last = self.w, past[-1]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"][:, 0], grad["shift"][0] = (last * keep).T @ d_out, d_out.sum()
        d_h = np.outer(d_out, w["out"][:, 0]) * keep
        for now, h, z, r, c in reversed(past[:-1]):
            d_c, d_z, d_before = d_h * z * (1 - c * c), d_h * (c - h) * z * (1 - z), d_h * (1 - z)
            d_rh = d_c @ w["ch"].T
            d_r = d_rh * h * r * (1 - r)
            d_before += d_rh * r
            for gate, d, state in (("z", d_z, h), ("r", d_r, h), ("c", d_c, r * h)):
                grad[gate + "x"] += now.T @ d
                grad[gate + "h"] += state.T @ d
                grad[gate + "b"] += d.sum(axis=0)
                if gate != "c":
                    d_before += d @ w[gate + "h"].T
            d_h = d_before
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, dropout: float, epochs: int, seed: int) -> None:
        """Adam over all windows at once; the weights with the least loss on the last fifth stay."""
        rng = np.random.default_rng(seed)
        held = max(1, len(x) // 5) if len(x) >= 5 else 0
        own = slice(0, len(x) - held)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        best, kept, since = np.inf, {k: v.copy() for k, v in self.w.items()}, 0
        for step in range(1, epochs + 1):
            keep = (rng.uniform(size=(len(x) - held, self.w["zh"].shape[0])) >= dropout) / (1 - dropout)
            out, past = self.forward(x[own], keep)
            grad = self.backward(past, np.clip(out - y[own], -1, 1) / len(out), keep)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            checked = slice(len(x) - held, None) if held else slice(None)
            loss = float(((self.forward(x[checked])[0] - y[checked]) ** 2).mean())
            since += 1
            if loss < best:
                best, kept, since = loss, {k: v.copy() for k, v in self.w.items()}, 0
            if since > PATIENCE:
                break
        self.w = kept


class Scale:
    """Logarithms (plain values where one is below 0), each column as 0.05..0.95."""

    def __init__(self, values: np.ndarray):
        self.logs = bool((values >= 0).all())
        z = np.log1p(values) if self.logs else values
        self.low, span = z.min(axis=0), np.ptp(z, axis=0)
        self.span = np.where(span > 0, span, 1.0) / 0.9

    def there(self, values: np.ndarray) -> np.ndarray:
        z = np.log1p(np.maximum(values, 0)) if self.logs else values
        return (z - self.low) / self.span + 0.05

    def back(self, scaled: np.ndarray, column: int = 0) -> np.ndarray:
        z = (scaled - 0.05) * self.span[column] + self.low[column]
        return np.expm1(z) if self.logs else z


def windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps before each row from the ``width``-th on, and the row's first column."""
    return np.stack([values[i : i + width] for i in range(len(values) - width)]), values[width:, 0]


def paths(cell: Cell, last: np.ndarray, inputs: np.ndarray, draws: int, dropout: float, seed: int) -> np.ndarray:
    """Forecasts that feed on themselves, a row a draw, the first without dropout; ``inputs`` are the other columns of the steps ahead."""
    rng = np.random.default_rng(seed)
    x = np.repeat(last[None], draws + 1, axis=0)
    out = np.empty((draws + 1, len(inputs)))
    for step, other in enumerate(inputs):
        keep = (rng.uniform(size=(draws + 1, cell.w["zh"].shape[0])) >= dropout) / (1 - dropout)
        keep[0] = 1
        out[:, step] = cell.forward(x, keep)[0]
        now = np.c_[out[:, step], np.repeat(other[None], draws + 1, axis=0)]
        x = np.concatenate([x[:, 1:], now[:, None]], axis=1)
    return out


def predicted(values: np.ndarray, ahead: np.ndarray, window: int, units: int, dropout: float, epochs: int, draws: int, seed: int) -> tuple[np.ndarray, ...] | None:
    """(middle, lower, upper) of the first column for the steps ahead, whose other columns are given; none of too short a series."""
    if len(values) - window < LEAST:
        return None
    scale = Scale(values)
    scaled = scale.there(values)
    cell = Cell(values.shape[1], units, seed)
    cell.train(*windows(scaled, window), dropout, epochs, seed)
    others = scale.there(np.c_[np.zeros(len(ahead)), ahead])[:, 1:]
    drawn = paths(cell, scaled[-window:], others, draws, dropout, seed)
    middle = drawn[0] if values.shape[1] > 1 else drawn[1:].mean(axis=0)
    return tuple(scale.back(x) for x in (middle, *np.percentile(drawn[1:], (5, 95), axis=0)))


def forecast(
    panel: DataFrame, key: str, value: str, steps: int, inputs: tuple[str, ...] = (), window: int = WINDOW, units: int = UNITS, dropout: float = DROPOUT, epochs: int = EPOCHS, draws: int | None = None, seed: int = 7,
) -> DataFrame:
    """(key, year, yhat, lower, upper) of the years after each key's last value.

    With inputs, years that have them but no value are forecast with them; beyond, inputs follow
    their own lines.  Draws are 200, or 150 with inputs.  Rows that lack an input in the history
    are left out; keys with fewer than ``window`` + 4 years give none.
    """
    names, draws = [value, *inputs], draws or (150 if inputs else DRAWS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        past = pdf.dropna(subset=names)
        out = {n: pd.Series(dtype=object) for n in (key, "year", "yhat", "lower", "upper")}
        if len(past) - window < LEAST:
            return pd.DataFrame(out)
        years = past["year"].to_numpy(float)
        ahead = years[-1] + np.arange(1, steps + 1)
        given = pdf[pdf["year"] > years[-1]].dropna(subset=list(inputs)).drop_duplicates("year").set_index("year") if inputs else None
        known = np.empty((steps, len(inputs)))
        for i, name in enumerate(inputs):
            line = np.polyval(np.polyfit(years, past[name].to_numpy(float), 1), ahead)
            known[:, i] = [given[name].get(int(y), own) for y, own in zip(ahead, line, strict=True)]
        found = predicted(past[names].to_numpy(float), known, window, units, dropout, epochs, draws, seed + zlib.crc32(str(pdf[key].iloc[0]).encode()))
        who = pd.Series([pdf[key].iloc[0]] * steps, dtype=object)
        return pd.DataFrame({key: who, "year": ahead.astype(np.int32), **dict(zip(("yhat", "lower", "upper"), found, strict=True))})

    year = F.col("year").cast("int").alias("year")
    rows = panel.groupBy(key, year).agg(*[F.avg(double(F.col(c))).alias(c) for c in names])
    kind = panel.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, year int, yhat double, lower double, upper double")
