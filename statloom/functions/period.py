"""Periods: a kind (year, ytd, quarter, month) and a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONTHS, PERIOD_RANK


def period_rank(period: Column) -> Column:
    """Full years rank first, then the wider spans; unknown kinds as months."""
    out = F.lit(0)
    for kind, rank in PERIOD_RANK.items():
        out = F.when(period == kind, rank).otherwise(out)
    return out


def period_key(period: Column, no: Column) -> Column:
    """A struct that orders periods within a year."""
    return F.struct(period_rank(period).alias("rank"), F.coalesce(no, F.lit(0)).alias("no"))


def is_partial(period: Column) -> Column:
    return period != "year"


def year_label(year: Column, period: Column) -> Column:
    """The year, with a star where it is not a full one."""
    return F.concat(year.cast("string"), F.when(is_partial(period), "*").otherwise(""))


def caption(period: Column, no: Column) -> Column:
    """What the period is called: jıl, yanvar–iyun, iyun, 2-sherek."""
    clamped = F.least(no, F.lit(12))
    month = F.get(F.array(*map(F.lit, MONTHS)), clamped - 1)
    known = no.isNotNull() & (no != 0)
    return (
        F.when((period == "ytd") & known & (clamped <= 1), MONTHS[0])
        .when((period == "ytd") & known, F.concat(F.lit(f"{MONTHS[0]}–"), month))
        .when((period == "month") & known, month)
        .when((period == "quarter") & known, F.concat(clamped.cast("string"), F.lit("-sherek")))
        .otherwise("jıl")
    )


def same_span(period: Column, no: Column, other_period: Column, other_no: Column) -> Column:
    """Whether two periods can be compared; both without number also can."""
    return period.eqNullSafe(other_period) & no.eqNullSafe(other_no)


def period_note(period: Column, no: Column) -> Column:
    """A caption in brackets where the period is partial."""
    return F.when(is_partial(period), F.concat(F.lit(" ("), caption(period, no), F.lit(")"))).otherwise("")


def quarter_middle(code: Column) -> Column:
    """The middle day of a quarter such as 2018Q1."""
    year = F.regexp_extract(code, r"^(\d{4})Q[1-4]$", 1)
    quarter = F.regexp_extract(code, r"^\d{4}Q([1-4])$", 1)
    return F.when(year != "", F.make_date(year.cast("int"), quarter.cast("int") * 3 - 1, F.lit(15)))


def year_middle(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(6), F.lit(15))
