"""Growth, shares, statuses, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(x: Column) -> Column:
    return x.cast("double")


def growth(value: Column, base: Column) -> Column:
    """Percent change to the absolute base; null where the base is missing or zero."""
    return double(value - base) / F.nullif(double(F.abs(base)), F.lit(0.0)) * 100


def percent(part: Column, whole: Column) -> Column:
    return double(part) / F.nullif(double(whole), F.lit(0.0)) * 100


def ratio(part: Column, whole: Column) -> Column:
    return double(part) / F.nullif(double(whole), F.lit(0.0))


def _steps(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The name of the first limit that the value reaches, from high to low."""
    out = F.lit(last)
    for limit, name in reversed(limits):
        out = F.when(value >= limit, name).otherwise(out)
    return out


def severity(yoy: Column) -> Column:
    """Status from growth; unknown growth is in progress."""
    known = _steps(yoy, [(5, "completed"), (0, "in_progress"), (-5, "at_risk")], "critical")
    return F.when(yoy.isNull(), "in_progress").otherwise(known)


def progress_status(progress: Column) -> Column:
    return _steps(progress, [(100, "completed"), (60, "in_progress"), (30, "at_risk")], "critical")


def completion_status(completion: Column) -> Column:
    return _steps(completion, [(95, "completed"), (80, "in_progress"), (60, "at_risk")], "critical")


def unemployment_class(rate: Column) -> Column:
    """0 below 6 percent, 1 below 9, else 2."""
    return F.when(rate < 6, 0).when(rate < 9, 1).otherwise(2)


def _formatted(value: Column, pattern: str) -> Column:
    """A number by a decimal pattern; halves, as the double holds them, to even."""
    return F.call_function("format_number", double(value), F.lit(pattern))


def amount(value: Column) -> Column:
    """Thousands by no-break spaces, one digit after the point unless it is 0; a dash for null."""
    text = F.regexp_replace(F.format_number(value, 1), r"\.0$", "")
    return F.coalesce(F.replace(text, F.lit(","), F.lit(" ")), F.lit("—"))


def signed_percent(value: Column) -> Column:
    return F.concat(_formatted(value, "+0.0;-0.0"), F.lit("%"))


def fixed(value: Column, digits: int = 1) -> Column:
    return F.coalesce(_formatted(value, "0." + "0" * digits if digits else "0"), F.lit("—"))


def compact(value: Column) -> Column:
    """Millions as mln, thousands as ming; a dash for null."""
    short = lambda x: F.regexp_replace(_formatted(x, "0.0"), r"\.0$", "")
    size = F.abs(value)
    return (
        F.when(value.isNull(), "—").when(size >= 1_000_000, F.concat(short(value / 1_000_000), F.lit(" mln")))
        .when(size >= 1_000, F.concat(short(value / 1_000), F.lit(" ming")))
        .otherwise(short(value))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def days_left(deadline: Column, as_of: Column) -> Column:
    return F.datediff(deadline, as_of)


def short_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def minmax(value: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Scaled from low..high to to_low..to_high; to_low where all are equal."""
    return F.coalesce(to_low + double(value - low) / F.nullif(double(high - low), F.lit(0.0)) * (to_high - to_low), F.lit(to_low))


def local_number(value: Column, digits: int = 1) -> Column:
    """Thousands by no-break spaces, a comma before at most so many digits, the minus sign U+2212; a dash for null."""
    text = F.regexp_replace(F.format_number(F.abs(value), digits), r"(\.\d*?)0+$", "$1")
    text = F.translate(F.regexp_replace(text, r"\.$", ""), ",.", "\u00a0,")
    return F.coalesce(F.concat(F.when((value < 0) & (text != "0"), "\u2212").otherwise(""), text), F.lit("—"))


def percent_text(value: Column, digits: int = 1) -> Column:
    """A percentage as text, a dash for null."""
    return F.when(value.isNotNull(), F.concat(fixed(value, digits), F.lit("%"))).otherwise("—")


def scaled_log(value: Column) -> Column:
    return F.log1p(double(value))


def unscaled_log(value: Column) -> Column:
    return F.expm1(value)
