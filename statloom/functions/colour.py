"""Colours as #rrggbb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NO_GROWTH, NO_VOLUME, PERFORMANCE_COLOURS, VOLUME_COLOURS
from .numbers import clamp


def ramp(x: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Piecewise linear between stops (place, rgb), level beyond them."""

    def mixed(a, b) -> Column:
        (p, low), (q, high) = a, b
        t = (x - p) / (q - p)
        return F.format_string("#%02x%02x%02x", *[F.floor(F.lit(i) + t * (j - i) + 0.5).cast("int") for i, j in zip(low, high, strict=True)])

    fixed = lambda rgb: F.lit("#%02x%02x%02x" % rgb)
    out = fixed(stops[-1][1])
    for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < b[0], mixed(a, b)).otherwise(out)
    return F.when(x <= stops[0][0], fixed(stops[0][1])).otherwise(out)


def performance(ratio: Column) -> Column:
    """From far behind (red) over level (grey) to ahead (blue)."""
    return ramp(ratio, PERFORMANCE_COLOURS)


def volume(intensity: Column) -> Column:
    """By the root of the share of the largest, so that one large district leaves the others apart."""
    return F.when(intensity.isNull(), NO_VOLUME).otherwise(ramp(F.sqrt(clamp(intensity, 0.0, 1.0)), VOLUME_COLOURS))


def growth(yoy: Column) -> Column:
    """Growth of -20 to 20 percent on the performance scale."""
    return F.when(yoy.isNull(), NO_GROWTH).otherwise(performance(1 + clamp(yoy, -20.0, 20.0) / 20 * 0.18))
