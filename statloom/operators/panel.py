"""Panels: differences, windows, features, extrapolation, scaling, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import double, minmax, unemployment_class


def differences(panel: DataFrame, key: str, value: str, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Changes to earlier rows of the key (by row, not by calendar year)."""
    line = Window.partitionBy(key).orderBy("year")
    return panel.select("*", *[(F.col(value) - F.lag(value, k).over(line)).alias(f"{value}_diff{k}") for k in lags])


def features(panel: DataFrame, key: str = "district_id") -> DataFrame:
    """Features of (key, year, active, employed, unemployed, rate); lags are taken before rows are dropped."""
    line = Window.partitionBy(key).orderBy("year")
    change = lambda c, k=1: F.col(c) - F.lag(c, k).over(line)
    share = lambda c: double(F.col(c)) / F.nullif(double(F.col("active")), F.lit(0.0))
    rows = panel.select(
        key, "year", "active", "employed", "unemployed", "rate",
        change("rate").alias("rate_diff"), change("rate", 2).alias("rate_diff2"), change("active").alias("active_diff"), change("employed").alias("employed_diff"),
        share("employed").alias("employed_share"), share("unemployed").alias("unemployed_share"),
        unemployment_class(F.col("rate")).alias("label"),
    )
    first = panel.agg(F.min("year").alias("first_year"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("year_index", F.col("year") - F.col("first_year")).drop("first_year")  # one row
    return rows.dropna(subset=["rate_diff", "active_diff", "employed_diff", "rate"])


def latest_worst(panel: DataFrame, value: str = "rate") -> DataFrame:
    """The rows of the last year, highest value first."""
    last = panel.agg(F.max("year").alias("year"))
    return panel.join(F.broadcast(last), "year").orderBy(F.desc(value))  # one row


def sliding_windows(panel: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """The ``width`` values before each row as an array, and the row's value as target."""
    line = Window.partitionBy(key).orderBy("year").rowsBetween(-width, -1)
    rows = panel.select(key, "year", F.collect_list(value).over(line).alias("window"), F.col(value).alias("target"))
    return rows.where(F.size("window") == width)


def joint_windows(panel: DataFrame, key: str, values: list[str], target: str, width: int) -> DataFrame:
    """Like ``sliding_windows`` with several values in each step."""
    line = Window.partitionBy(key).orderBy("year").rowsBetween(-width, -1)
    step = F.array(*[double(F.col(c)) for c in values])
    rows = panel.select(key, "year", F.collect_list(step).over(line).alias("window"), F.col(target).alias("target"))
    return rows.where(F.size("window") == width)


def extrapolated(panel: DataFrame, key: str, value: str, steps: int, over: int = 3) -> DataFrame:
    """Years after each key's last: the last value grown by the mean of its last ``over`` growth rates."""
    line = Window.partitionBy(key).orderBy("year")
    rows = panel.withColumn("g", double(F.col(value)) / F.nullif(double(F.lag(value).over(line)), F.lit(0.0)) - 1)
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("year"))))
    ends = rows.where(F.col("back") <= over).groupBy(key).agg(
        F.max("year").alias("last_year"), F.max_by(double(F.col(value)), "year").alias("last"), F.sort_array(F.collect_list(F.struct("year", "g"))).alias("gs")
    )
    mean = F.aggregate("gs", F.lit(0.0), lambda a, x: a + F.coalesce(x["g"], F.lit(0.0))) / F.greatest(F.size(F.filter("gs", lambda x: x["g"].isNotNull())), F.lit(1))
    rows = ends.withColumn("rate", mean).select(key, "last_year", "last", "rate", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return rows.select(key, (F.col("last_year") + F.col("step")).alias("year"), (F.col("last") * F.pow(1 + F.col("rate"), F.col("step"))).alias("value"))


def scaled(panel: DataFrame, key: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each value between the key's least and largest, as low to high."""
    own = Window.partitionBy(key)
    return panel.withColumn("scaled", minmax(F.col(value), F.min(value).over(own), F.max(value).over(own), low, high))


def wide(long: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """A row for each ``row``, a column for each name."""
    return long.groupBy(row).pivot(column, names).agg(F.first(value))


def long(wide_rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row for each key and column with a value."""
    return wide_rows.unpivot(keys, names, "name", "value").where("value is not null")


def chunks_to_rows(wide_rows: DataFrame, key: str, chunks: dict[int, list[str]], names: list[str]) -> DataFrame:
    """Groups of columns, one for each year, as rows; a row with any null is left out."""
    each = F.array(*[F.struct(F.lit(y).alias("year"), *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]) for y, cols in chunks.items()])
    return wide_rows.select(key, F.inline(each)).dropna()


def enough(panel: DataFrame, key: str, value: str, least: int, above: float = 0.0, below: float | None = None) -> DataFrame:
    """Values in a range, of keys with at least so many of them."""
    rows = panel.where(F.col(value) > above)
    rows = rows if below is None else rows.where(F.col(value) < below)
    return rows.join(rows.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def common_years(*series: DataFrame) -> DataFrame:
    """The years that all series have."""
    out = series[0].select("year").distinct()
    for other in series[1:]:
        out = out.join(other.select("year").distinct(), "year")
    return out


def balance(export: DataFrame, imports: DataFrame) -> DataFrame:
    """Export less import in the years of both."""
    both = export.select("year", F.col("value").alias("export")).join(imports.select("year", F.col("value").alias("import")), "year")
    return both.withColumn("balance", F.col("export") - F.col("import"))


def split_by_years(panel: DataFrame, years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Training rows and test rows."""
    return panel.where(~F.col("year").isin(years)), panel.where(F.col("year").isin(years))


def peak(points: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """The index of the first largest absolute value of each key."""
    return points.groupBy(key).agg(F.max_by(index, F.struct(F.abs(F.col(value)), -F.col(index))).alias("peak"))



def full_years(rows: DataFrame, last: int) -> DataFrame:
    """Without the year after the last full one."""
    return rows.where(F.col("year") <= last)


def transposed(rows: DataFrame, key: str, columns: list[str], names: list) -> DataFrame:
    """A row for each of the columns, a column for each of the key's values named."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    long_rows = rows.select(F.col(key).cast("string").alias("key"), each).select("key", "x.*")
    return long_rows.groupBy("name").agg(*[F.max(F.when(F.col("key") == str(n), F.col("value"))).alias(f"c{n}") for n in names])


def bounds(rows: DataFrame, key: str, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The percentiles of each key, and the mean of logarithms."""
    return rows.groupBy(key).agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"), F.avg(F.log1p(value)).alias("mean_log"))


def unioned_years(a: DataFrame, b: DataFrame) -> DataFrame:
    """Years that either has."""
    return a.select("year").unionByName(b.select("year")).distinct()


def best_and_worst(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of each year how many keys have a value, and those with the least and the largest (ties to the smaller key)."""
    own = rows.where(F.col(value).isNotNull())
    return own.groupBy("year").agg(
        F.count_distinct(key).alias("n"), F.min_by(key, F.struct(F.col(value), F.col(key))).alias("least"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("largest")
    )


def ends_of_year(rows: DataFrame, key: str, value: str, n: int = 3) -> DataFrame:
    """Of each year the n keys with the least and the n with the largest value."""
    up, down = (Window.partitionBy("year").orderBy(order, key) for order in (F.asc(value), F.desc(value)))
    own = rows.where(F.col(value).isNotNull()).withColumn("from_least", F.row_number().over(up)).withColumn("from_largest", F.row_number().over(down))
    return own.where((F.col("from_least") <= n) | (F.col("from_largest") <= n)).select(key, "year", value, "from_least", "from_largest")
