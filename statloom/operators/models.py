"""Forecasts, their measures, ensembles, and the early-warning classifier."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import double
from ..lineage import cut
from . import boosting

FEATURES = [
    "rate", "rate_diff", "active", "employed", "unemployed", "active_diff", "employed_diff",
    "employed_share", "unemployed_share", "year_index",
]


def _ahead(pdf: pd.DataFrame, key: str, years: np.ndarray, yhat: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> pd.DataFrame:
    names = pd.Series([pdf[key].iloc[0]] * len(years), dtype=object) if len(years) else pd.Series(np.empty(0, object))
    return pd.DataFrame({key: names, "year": years.astype(np.int32), "yhat": yhat, "lower": lower, "upper": upper})


def trend_forecast(panel: DataFrame, key: str, value: str, steps: int, level: float = 1.645) -> DataFrame:
    """A linear trend in logarithms (plain where values aren't positive) for each key, with 90 percent bounds.

    Years follow the key's last; keys with fewer than three values give none.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values("year")
        x, y = pdf["year"].to_numpy(float), pdf[value].to_numpy(float)
        if len(x) < 3:
            return _ahead(pdf, key, np.empty(0), *[np.empty(0)] * 3)
        logs = bool((y > 0).all())
        z = np.log(y) if logs else y
        slope, start = np.polyfit(x, z, 1)
        spread = np.sqrt(((z - slope * x - start) ** 2).sum() / max(1, len(x) - 2))
        ahead = x[-1] + np.arange(1, steps + 1)
        middle = slope * ahead + start
        width = level * spread * np.sqrt(1 + 1 / len(x) + (ahead - x.mean()) ** 2 / max(((x - x.mean()) ** 2).sum(), 1e-9))
        back = np.exp if logs else (lambda v: v)
        return _ahead(pdf, key, ahead, back(middle), back(middle - width), back(middle + width))

    rows = panel.select(key, "year", F.col(value).cast("double").alias(value))
    kind = panel.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, year int, yhat double, lower double, upper double")


def measures(rows: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE, MAPE, R2, accuracy and coverage of (actual, yhat, lower, upper)."""
    actual, error = double(F.col("actual")), double(F.col("actual")) - double(F.col("yhat"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error) / F.nullif(F.abs(actual), F.lit(0.0))) * 100).alias("mape"),
        F.sum(error * error).alias("sse"), F.var_pop(actual).alias("v"),
        (F.count_if((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))) / F.count("*")).alias("coverage"),
    )
    r2 = 1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0))
    return sums.select(*keys, "n", "mae", "rmse", "mape", r2.alias("r2"), F.greatest(F.lit(0.0), 100 - F.col("mape")).alias("accuracy"), "coverage")


def ensemble(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Forecasts (mape, yhat) combined with weights that fall with the error, at least 0.1."""
    weight = 1 / F.greatest(double(F.col("mape")), F.lit(0.1))
    rows = forecasts.withColumn("w", weight)
    return rows.groupBy(*keys).agg((F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"), F.count("*").alias("models"))


def winners(forecasts: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Of each key the model whose forecast is nearest to the truth; ties to the first name."""
    rows = forecasts.join(truth, list(keys)).withColumn("error", F.abs(double(F.col("yhat")) - double(F.col("actual"))))
    best = Window.partitionBy(*keys).orderBy("error", "model")
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").select(*keys, "model", "error")


def best_configuration(scores: DataFrame, *keys: str) -> DataFrame:
    """The configuration of each key with the least error."""
    return scores.groupBy(*keys).agg(F.min_by("configuration", F.struct("mape", "configuration")).alias("configuration"), F.min("mape").alias("mape"))


def early_warning(features: DataFrame, trees: int = 60, depth: int = 4, seed: int = 42):
    """A fitted pipeline: a forest over the features, label 0 to 2."""
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(features)


def boosted_warning(features: DataFrame, rounds: int = 200, **settings) -> boosting.Boosted:
    """Boosted trees over the features, label 0 to 2."""
    return boosting.fit(features, FEATURES, "label", 3, rounds, **settings)


def warned(model, features: DataFrame, key: str = "district_id") -> DataFrame:
    """Predictions of a forest or of boosted trees with the probability of each class and whether they are right."""
    if isinstance(model, boosting.Boosted):
        rows = boosting.scored(model, features, [key, "year", "rate", "label"])
        return rows.select(key, "year", "rate", "label", "predicted", (F.col("predicted") == F.col("label")).alias("right"), "p0", "p1", "p2")
    p = vector_to_array("probability")
    rows = model.transform(features)
    return rows.select(
        key, "year", "rate", "label", F.col("prediction").cast("int").alias("predicted"), (F.col("prediction") == F.col("label")).alias("right"),
        *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(3)],
    )


def importances(model) -> list[tuple[str, float]]:
    """Features by importance, largest first."""
    if isinstance(model, boosting.Boosted):
        return model.importances()
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, map(float, values), strict=True), key=lambda x: -x[1])


def top_importances(model, n: int = 5) -> list[tuple[str, float]]:
    return importances(model)[:n]


def folds(rows: DataFrame, label: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Rows with ``fold``: each label's rows dealt evenly."""
    dealt = rows.withColumn("_h", F.xxhash64(F.lit(seed), *rows.columns))
    sliced = dealt.withColumn("_slice", F.pmod("_h", F.lit(1024)))
    held = sliced.groupBy(label, "_slice").agg(F.count("*").alias("_held"))  # a hot label is numbered in slices
    upto = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select(F.col(label).alias("_label"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_held").over(upto), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h"))
    numbered = sliced.withColumn("_nth", within).join(firsts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_s")))
    return numbered.select(*rows.columns, ((F.col("_first") + F.col("_nth") - 1) % n).cast("int").alias("fold"))


def macro_f1(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The mean over labels of F1."""
    each = F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    both = predictions.select(each.alias("x")).select("x.*").groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    hits = predictions.where(F.col(label) == F.col(predicted)).groupBy(F.col(label).alias("c")).agg(F.count("*").alias("h"))
    f1 = 2 * F.coalesce("h", F.lit(0)) / (F.col("t") + F.col("p"))
    return both.join(hits, "c", "left").agg(F.avg(f1).alias("macro_f1"))


def classification_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1 and support of each class that occurs; 0 where one is not defined."""
    pair = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    both = predictions.select(F.inline(pair), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    sums = both.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum(F.col("t") * F.col("hit")).alias("hits"))
    share = lambda whole: F.coalesce(double(F.col("hits")) / F.nullif(double(whole), F.lit(0.0)), F.lit(0.0))
    rows = sums.select("class", share(F.col("said")).alias("precision"), share(F.col("support")).alias("recall"), share((F.col("support") + F.col("said")) / 2).alias("f1"), "support")
    return rows


def report_averages(report: DataFrame) -> DataFrame:
    """The macro and the weighted mean of a classification report."""
    names = ("precision", "recall", "f1")
    macro = report.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("average", F.lit("macro"))
    weighted = report.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return macro.unionByName(weighted.withColumn("average", F.lit("weighted")))


def cross_validated(rows: DataFrame, key: str, n: int = 5, fit: Callable[[DataFrame], object] = early_warning) -> DataFrame:
    """(fold, macro_f1) of a classifier fitted on all other folds; few folds, one after another."""
    dealt = cut(folds(rows.select(key, "year", "rate", "label", *[c for c in FEATURES if c != "rate"]), "label", n))
    scores = None
    for fold in range(n):
        model = fit(dealt.where(F.col("fold") != fold))
        own = macro_f1(warned(model, dealt.where(F.col("fold") == fold), key)).withColumn("fold", F.lit(fold))
        scores = own if scores is None else scores.unionByName(own)
    return scores.select("fold", "macro_f1")


def score_summary(scores: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and standard deviation (of the population) of scores."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def line_fit(panel: DataFrame, key: str, value: str) -> DataFrame:
    """slope, start (of a straight line over the years), n, and the spread around it, of each key."""
    x, y = double(F.col("year")), double(F.col(value))
    sums = panel.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("start"), F.count("*").alias("n"),
        F.regr_syy(y, x).alias("syy"), F.coalesce(F.regr_sxy(y, x), F.lit(0.0)).alias("sxy"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"))
    return sums.select(key, "slope", "start", "n", spread.alias("spread"))


def trend_of(panel: DataFrame, key: str, value: str) -> DataFrame:
    """The fitted trend beside each value, and what is left: key, year, value, trend, rest."""
    fit = line_fit(panel, key, value)
    trend = F.col("start") + F.col("slope") * F.col("year")
    return panel.join(fit, key).select(key, "year", double(F.col(value)).alias(value), trend.alias("trend"), (double(F.col(value)) - trend).alias("rest"))


def with_future(history: DataFrame, forecast: DataFrame, key: str, value: str) -> DataFrame:
    """History and forecast as one frame (key, year, value, lower, upper, future); bounds only for the future."""
    none = F.lit(None).cast("double")
    past = history.select(key, F.col("year").cast("int").alias("year"), double(F.col(value)).alias("value"), none.alias("lower"), none.alias("upper"), F.lit(False).alias("future"))
    ahead = forecast.select(key, F.col("year").cast("int").alias("year"), F.col("yhat").alias("value"), "lower", "upper", F.lit(True).alias("future"))
    return past.unionByName(ahead)


def quarterly_forecast(rows: DataFrame, key: str, value: str, steps: int = 12) -> DataFrame:
    """The next quarters of each key (key, year, quarter, value): a straight line, times the quarter's mean share of it.

    Keys with fewer than eight quarters give none.
    """
    place = (F.col("year") * 4 + F.col("quarter") - 1).alias("at")
    dated = rows.where(F.col(value).isNotNull()).select(key, place, F.col("quarter"), double(F.col(value)).alias("y"))
    fit = line_fit(dated.select(key, F.col("at").alias("year"), F.col("y").alias(value)), key, value).where("n >= 8")
    ends = dated.groupBy(key).agg(F.max("at").alias("last"))
    line = F.col("start") + F.col("slope") * F.col("at")
    season = dated.join(fit, key).groupBy(key, "quarter").agg(F.coalesce(F.avg(F.col("y") / F.nullif(line, F.lit(0.0))), F.lit(1.0)).alias("share"))
    ahead = fit.join(ends, key).select("*", F.explode(F.sequence(F.col("last") + 1, F.col("last") + steps)).alias("at"))
    ahead = ahead.withColumn("quarter", (F.col("at") % 4 + 1).cast("int"))
    return ahead.join(season, [key, "quarter"], "left").select(
        key, F.floor(F.col("at") / 4).cast("int").alias("year"), "quarter", (line * F.coalesce("share", F.lit(1.0))).alias("yhat")
    )


def autoregressive_forecast(panel: DataFrame, key: str, value: str, steps: int, inputs: list[str] = [], draws: int = 200, seed: int = 7) -> DataFrame:  # noqa: B006
    """(key, year, yhat, lower, upper): each year from the one before and the inputs of the one before, by least squares.

    Values are scaled to 0..1.  Bounds are the 5th and 95th percentile of ``draws`` paths with
    residuals drawn again.  With inputs, these follow their own lines.  Keys with fewer than
    four values give none.
    """
    names = [value, *inputs]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=names).sort_values("year")
        if len(pdf) < 4:
            return _ahead(pdf, key, np.empty(0), *[np.empty(0)] * 3)
        values = pdf[names].to_numpy(float)
        low, span = values.min(axis=0), np.where(np.ptp(values, axis=0) > 0, np.ptp(values, axis=0), 1.0)
        z, years = (values - low) / span, pdf["year"].to_numpy(float)
        x = np.c_[np.ones(len(z) - 1), z[:-1]]
        weights = np.linalg.lstsq(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ z[1:, 0], rcond=None)[0]
        rest = z[1:, 0] - x @ weights
        rng = np.random.default_rng(seed)
        lines = [np.polyfit(years, z[:, i], 1) for i in range(1, z.shape[1])]
        paths, state = np.empty((draws + 1, steps)), np.repeat(z[-1:, :], draws + 1, axis=0)
        for step in range(steps):
            noise = np.r_[0.0, rng.choice(rest, draws)]  # the first path has none
            following = np.c_[np.ones(draws + 1), state] @ weights + noise
            paths[:, step] = following
            ahead = [np.full(draws + 1, np.polyval(line, years[-1] + step + 1)) for line in lines]
            state = np.column_stack([following, *ahead])
        paths = paths * span[0] + low[0]
        bounds = np.percentile(paths[1:], (5, 95), axis=0)
        return _ahead(pdf, key, years[-1] + np.arange(1, steps + 1), paths[0], bounds[0], bounds[1])

    rows = panel.select(key, "year", *[double(F.col(c)).alias(c) for c in names])
    kind = panel.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, year int, yhat double, lower double, upper double")


def summary_of(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """Of each indicator (history: indicator, year, value) its last value, its last forecast, and the change between them in percent."""
    last = history.groupBy("indicator").agg(F.max_by("value", "year").alias("last_value"), F.max("year").alias("last_year"))
    ahead = forecasts.groupBy("indicator").agg(F.max_by("yhat", "year").alias("forecast"), F.max("year").alias("forecast_year"))
    change = (F.col("forecast") - F.col("last_value")) / F.nullif(F.abs("last_value"), F.lit(0.0)) * 100
    return last.join(ahead, "indicator").select("indicator", "last_year", "last_value", "forecast_year", "forecast", change.alias("change"))


def save(model, path: str) -> None:
    """A fitted pipeline, or boosted trees, written to a folder, over what is there."""
    if isinstance(model, boosting.Boosted):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)


def loaded(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
