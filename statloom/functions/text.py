"""Names and questions as text: normal forms, slugs, keywords.

Two normal forms are kept apart: one for searching, one for reading district names from
workbooks.  Decomposing Unicode has no built-in function, so it goes through an
Arrow-batched function; the letter tables are built-in ``translate``.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import CITY, CORE_MODULES, DISTRICT_NAMES, GROWTH_HINTS, REPUBLIC, REPUBLIC_NAMES, SEARCH_LETTERS, UNIT_HINTS

_TO = {k: v for k, v in SEARCH_LETTERS.items() if v}
_DROPPED = [k for k, v in SEARCH_LETTERS.items() if not v]
_FROM_LETTERS, _TO_LETTERS = "".join([*_TO, *_DROPPED]), "".join(_TO.values())


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Decomposed, combining marks dropped."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(lambda t: None if t is None else plain(t))


def search_form(text: Column) -> Column:
    """Lower case, without marks and apostrophes."""
    return F.translate(without_marks(F.lower(text)), _FROM_LETTERS, _TO_LETTERS)


def district_form(text: Column) -> Column:
    """Lower case, without marks, letters a to z only, single spaces."""
    letters = F.translate(without_marks(F.lower(F.trim(text))), "ıǵğńóú", "iggnou")
    return F.trim(F.regexp_replace(F.regexp_replace(letters, r"[^a-z\s]", " "), r"\s+", " "))


def district_of(form: Column) -> Column:
    """District id of a district form: the republic, the city before its district, whole name, first word."""
    names = F.create_map(*[F.lit(x) for pair in DISTRICT_NAMES.items() for x in pair])
    republic = F.lit(False)
    for name in REPUBLIC_NAMES:
        republic = republic | F.startswith(form, F.lit(name))
    city = F.startswith(form, F.lit("nokis")) & form.rlike(r"\b(qalasi|qala|q)\b")
    first = F.substring_index(form, " ", 1)
    return F.when(form == "", None).when(republic, REPUBLIC).when(city, CITY).otherwise(F.coalesce(F.try_element_at(names, form), F.try_element_at(names, first)))


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """Readable key: letters and digits with dashes, at most 100, and a digest of the whole."""

    def one(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        plain = "".join(SEARCH_LETTERS.get(c, c) for c in plain)
        kept = "".join(c if c.isascii() and c.isalnum() else " " for c in plain)
        return "-".join(kept.split())[:100].strip("-") + "-" + hashlib.blake2s(t.encode(), digest_size=4).hexdigest()

    return text.map(lambda t: None if t is None else one(t))


def short_unit(unit: Column) -> Column:
    """The part after the last semicolon, without dashes around it."""
    return F.trim(F.regexp_replace(F.substring_index(unit, ";", -1), r"^[ \-–—]+|[ \-–—]+$", ""))


def is_volume(name: Column, unit: Column) -> Column:
    """Whether name and unit hold none of the hints of a growth rate."""
    text = F.lower(F.concat_ws(" ", name, unit))
    found = F.lit(False)
    for hint in GROWTH_HINTS:
        found = found | F.contains(text, F.lit(hint))
    return ~found


def core_module(name: Column, needles: list[tuple[str, str]] = CORE_MODULES) -> Column:
    """The module of the first needle that the lower-case name holds, in the order of the list."""
    out = F.lit(None).cast("string")
    for needle, module in reversed(needles):
        out = F.when(F.contains(F.lower(name), F.lit(needle)), module).otherwise(out)
    return out


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(F.lower(text), F.lit(needle))
    return found


def looks_like_unit(text: Column) -> Column:
    return (F.trim(text) != "") & (F.length(F.trim(text)) <= 60) & contains_any(text, UNIT_HINTS)


def number_of(text: Column) -> Column:
    """A cell's number: spaces dropped, a comma is a point; null where it isn't one."""
    plain = F.replace(F.translate(F.trim(text), "  ", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def question_form(text: Column) -> Column:
    """Search form without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(search_form(text), r"(?U)[^\w\s]+", " "), r"\s+", " "))


def has_keyword(text: Column, keys: list[str]) -> Column:
    """Whether a word of the text begins with one of the keys (given in search form)."""
    cleaned = [" ".join("".join(c if c.isalnum() or c == "_" else " " for c in k).split()) for k in keys]
    return text.rlike(r"(?U)\b(?:" + "|".join(cleaned) + ")")


def first_keyword(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first name, in order, with a keyword in the text."""
    out = F.lit(None).cast("string")
    for name, keys in reversed(keywords.items()):
        out = F.when(has_keyword(text, keys), name).otherwise(out)
    return out


def matched_length(alias: Column, text: Column, least: int = 5) -> Column:
    """Length of the longest beginning of the alias, of ``least`` or more letters, in the text; else 0."""
    lengths = F.when(F.length(alias) >= least, F.sequence(F.lit(least), F.length(alias))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(lengths, lambda n: F.contains(text, F.substring(alias, F.lit(1), n)))), F.lit(0))


def last_year_in(text: Column) -> Column:
    """The last 201x or 202x that stands alone in the text."""
    found = F.regexp_extract_all(text, F.lit(r"\b(20[12]\d)\b"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("int")


def speakable(markdown: Column, limit: int = 1000) -> Column:
    """Markdown without its marks, cut to a length."""
    text = F.regexp_replace(markdown, r"```[\s\S]*?```", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"[*_`#>|]+", " ")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def cache_key(*parts: Column) -> Column:
    """A digest that names a request: the parts, nulls as empty, apart by a sign that none holds."""
    return F.md5(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x1f"))


def structured(answer: Column, schema: str) -> Column:
    """The JSON object in a text, from its first to its last brace; null where there is none that can be read."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def first_named(text: Column, names: list[str]) -> Column:
    """The name, of a list, that the text holds first in the order of the list; null without."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.contains(F.lower(text), F.lit(name.lower())), name).otherwise(out)
    return out
