"""What a cell's text says: a period, a month span, a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BREAKDOWNS, FIRST_YEAR, LAST_YEAR, MONTHS, UNIT_HINTS

_YEAR = r"((?:19|20)\d{2})"


def _in_years(year: Column) -> Column:
    return year.between(FIRST_YEAR, LAST_YEAR)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")  # null where nothing is found


def parsed_period(text: Column) -> Column:
    """year, period and period_no of a heading, null if it names none.

    In this order: codes such as 2019M1 and 2018Q1 (Latin or Cyrillic, in range); a plain
    number, which is a year or nothing; the first year in the text with a quarter, with the
    last month named (of twelve: the full year), or alone.
    """
    code = rf"(?iu)^\s*{_YEAR}\s*([mм]|[qк])\s*(\d{{1,2}})\s*$"
    code_year, kind, no = _number(text, code, 1), F.lower(F.regexp_extract(text, code, 2)), _number(text, code, 3)
    by_month = kind.isin("m", "м")
    coded = code_year.isNotNull() & _in_years(code_year) & no.between(1, F.when(by_month, 12).otherwise(4))

    plain = F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(plain, F.trim(text).try_cast("double"))

    year, low = _number(text, _YEAR, 1), F.lower(text)
    quarter = _number(low, r"([1-4])\s*-?\s*sherek", 1)
    month = F.array_max(F.array(*[F.when(F.contains(low, F.lit(m)), i + 1).otherwise(0) for i, m in enumerate(MONTHS)]))

    period = lambda y, p, n: F.struct(y.cast("int").alias("year"), p.alias("period"), n.cast("int").alias("period_no"))
    none = F.lit(None).cast("int")
    named = (
        F.when(quarter.isNotNull(), period(year, F.lit("quarter"), quarter))
        .when(month.between(1, 11), period(year, F.lit("ytd"), month))
        .otherwise(period(year, F.lit("year"), none))
    )
    return (
        F.when(coded, period(code_year, F.when(by_month, "month").otherwise("quarter"), no))
        .when(plain & (value == F.floor(value)) & _in_years(value), period(value, F.lit("year"), none))
        .when(~plain & year.isNotNull() & _in_years(year), named)
    )


def month_span(text: Column) -> Column:
    """The last month of a heading without year such as Yanvar or Yanvar-fevral; null else."""
    span = r"(?iu)^\s*yanvar(?:\s*-\s*([a-zıáǵńóú]+))?\s*[¹²³⁴*]*\s*$"
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    last = F.lower(F.regexp_extract(flat, span, 1))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(last == "", MONTHS[0]).otherwise(last)).cast("int")
    return F.when(flat.rlike(span) & ~text.rlike(_YEAR) & (month > 0), month)


def year_heading(text: Column) -> Column:
    """The year of a short cell."""
    year = _number(text, _YEAR, 1)
    return F.when((F.length(text) <= 20) & _in_years(year), year)


def is_breakdown(text: Column) -> Column:
    """Whether the text opens a list of parts."""
    return F.lower(F.trim(text)).isin(BREAKDOWNS)


def _has_hint(text: Column) -> Column:
    found = F.lit(False)
    for hint in UNIT_HINTS:
        found = found | F.contains(F.lower(text), F.lit(hint))
    return found


def unit_in_brackets(texts: Column) -> Column:
    """The first bracketed text with a unit's hint, in the order of the texts; null without."""
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"\(([^)]{2,60})\)"), 1)))
    return F.trim(F.get(F.filter(found, _has_hint), F.lit(0)))


def unit_alone(texts: Column) -> Column:
    """The first short text that names millions, thousands of millions or thousands; null without."""
    short = F.filter(texts, lambda t: (F.length(t) < 40) & F.lower(t).rlike("mlrd|mln|mıń"))
    return F.trim(F.get(short, F.lit(0)))
