"""Which model forecasts which indicator, and what is done where it cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import backtest, changepoints, recurrent
from .models import trend_forecast

#: Indicator to (model, its inputs); others take changepoints.
DRIVERS = {"export": ("recurrent", ()), "investment": ("recurrent", ("export",)), "services": ("ensemble", ("export",))}
#: Years at the end of a history on which the parts of an ensemble are weighed.
HELD_OUT = 2

OUT = "indicator string, year int, yhat double, lower double, upper double, model string"


def forecast(wide: DataFrame, target: str | None = None, steps: int = 5, drivers: dict = DRIVERS) -> DataFrame:
    """(indicator, year, yhat, lower, upper, model) of one indicator of a yearly frame (year and a column for each), or of all.

    ``steps`` is kept within 1 and 10.  An indicator takes the model that its driver names:
    ``recurrent``, ``changepoints``, ``line`` (a straight line in logarithms), or ``ensemble`` (the
    first two, weighted by their errors on the last years).  Where a recurrent cell has too few
    years, changepoints take its place; below three years nothing is forecast.  An unknown
    indicator gives no rows.
    """
    steps, known = max(1, min(steps, 10)), [c for c in wide.columns if c != "year"]
    empty = wide.sparkSession.createDataFrame([], OUT)
    wanted = known if target is None else [c for c in known if c == target]
    if not wanted:
        return empty
    models = {name: drivers.get(name, ("changepoints", ())) for name in wanted}
    of = lambda *kinds: [name for name in wanted if models[name][0] in kinds]
    parts = []
    if lines := of("line"):
        parts.append(trend_forecast(_long(wide, lines), "indicator", "value", steps).withColumn("model", F.lit("line")))
    steady = of("changepoints", "recurrent", "ensemble")
    ahead = changepoints.yearly_forecast(_long(wide, steady), "indicator", "value", steps) if steady else None
    learnt = {}
    for inputs in sorted({tuple(i for i in models[name][1] if i in known) for name in of("recurrent", "ensemble")}):
        own = [name for name in of("recurrent", "ensemble") if tuple(i for i in models[name][1] if i in known) == inputs]
        learnt[inputs] = recurrent.forecast(_long(wide, own, inputs), "indicator", "value", steps, inputs)
    every = None
    for df in learnt.values():
        every = df if every is None else every.unionByName(df)
    if steady:
        alone = ahead.where(F.col("indicator").isin(of("changepoints"))).withColumn("model", F.lit("changepoints"))
        parts.append(alone)
    if every is not None:
        parts.append(every.where(F.col("indicator").isin(of("recurrent"))).withColumn("model", F.lit("recurrent")))
        lacking = ahead.where(F.col("indicator").isin(of("recurrent", "ensemble"))).join(every.select("indicator").distinct(), "indicator", "left_anti")
        parts.append(lacking.withColumn("model", F.lit("changepoints")))
    for name in of("ensemble"):
        inputs = tuple(i for i in models[name][1] if i in known)
        own = _long(wide, [name], inputs)
        last = own.where("value is not null").agg(F.max("year")).first()[0]
        if last is not None:
            both = {"changepoints": ahead.where(F.col("indicator") == name), "recurrent": every.where(F.col("indicator") == name)}
            configurations = tuple(backtest.Configuration(m, m) for m in both)
            mixed = backtest.weighted(own, "indicator", "value", both, configurations, (int(last) - HELD_OUT,), HELD_OUT, inputs)
            there = every.where(F.col("indicator") == name).select("indicator").distinct()
            parts.append(mixed.join(there, "indicator", "left_semi").withColumn("model", F.lit("ensemble")))
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def _long(wide: DataFrame, names: list[str], inputs: tuple[str, ...] = ()) -> DataFrame:
    """indicator, year, value, and the inputs beside each row."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    return wide.select("year", *inputs, each).select("x.indicator", "year", "x.value", *inputs)
