"""Questions in words: what is asked, and answers made from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTENT_KEYWORDS, MODULE_KEYWORDS
from ..functions.numbers import amount, signed_percent
from ..functions.text import first_keyword, question_form
from ..lineage import broadcast_if_small, cut
from .map_layer import extremes, map_layer

#: Letters of a name that a question must hold at least.
STEM = 5


def alias_index(districts: DataFrame, least: int = STEM) -> DataFrame:
    """(prefix, district_id, stem, longest): every beginning of ``least`` letters or more of a name, id or Russian name.

    A beginning that several districts share is the smaller id's; ``longest`` is the length of the
    longest alias with the same first letters (its stem).
    """
    names = districts.select(F.col("district_id"), F.explode(F.array("name", "district_id", "name_ru")).alias("alias"))
    names = names.select("district_id", question_form(F.col("alias")).alias("alias")).where(F.length("alias") >= least)
    each = names.select("district_id", F.explode(F.transform(F.sequence(F.lit(least), F.length("alias")), lambda n: F.substring(F.col("alias"), F.lit(1), n))).alias("prefix"))
    firsts = each.groupBy("prefix").agg(F.min("district_id").alias("district_id")).withColumn("stem", F.substring("prefix", 1, least))
    longest = firsts.groupBy("stem").agg(F.max(F.length("prefix")).alias("longest"))
    return firsts.join(longest, "stem").select("prefix", "district_id", "stem", "longest")


def places_named(asked: DataFrame, districts: DataFrame, least: int = STEM) -> DataFrame:
    """(id, district_id) of the rows (id, q: a question in search form) that hold a beginning of an alias; the longest wins, then the smaller id.

    Runs of letters of a question meet the index by equality: first the stems, then, where one is
    found, all beginnings that go on from there.  No question is held against every alias.
    """
    index = cut(alias_index(districts, least))
    stems = index.select("stem", "longest").distinct()
    longest = stems.agg(F.max("longest")).first()[0] or least  # one number
    starts = F.sequence(F.lit(1), F.length("q") - (least - 1))
    tails = F.array_distinct(F.transform(starts, lambda at: F.substring(F.col("q"), at, F.lit(longest))))
    held = asked.where(F.length("q") >= least).select("id", F.explode(tails).alias("tail"))
    met = held.withColumn("stem", F.substring("tail", 1, least)).join(broadcast_if_small(stems), "stem")
    upto = F.sequence(F.lit(least), F.least(F.length("tail"), "longest"))
    runs = met.select("id", F.explode(F.transform(upto, lambda n: F.substring(F.col("tail"), F.lit(1), n))).alias("prefix"))
    hits = runs.join(broadcast_if_small(index.select("prefix", "district_id")), "prefix")
    return hits.groupBy("id").agg(F.min_by("district_id", F.struct(-F.length("prefix"), "district_id")).alias("district_id"))


def parsed(questions: DataFrame, districts: DataFrame) -> DataFrame:
    """intent, district_id and module of each row (id, prompt).

    The district is the one with the longest beginning of a name in the prompt, ties to the
    smaller id; module and intent are the first with a keyword at the start of a word.
    An open question about a module or district is about that.  A null prompt is an empty one.
    """
    asked = questions.withColumn("q", F.coalesce(question_form(F.col("prompt")), F.lit("")))
    rows = asked.join(places_named(asked.select("id", "q").distinct(), districts), "id", "left")
    rows = rows.withColumn("module", first_keyword(F.col("q"), MODULE_KEYWORDS))
    intent = first_keyword(F.col("q"), INTENT_KEYWORDS)
    rest = F.when(F.col("module").isNotNull(), "module").when(F.col("district_id").isNotNull(), "district").otherwise("overview")
    return rows.select("id", F.coalesce(intent, rest).alias("intent"), "district_id", "module")


def context(obs: DataFrame, districts: DataFrame, year: int) -> DataFrame:
    """Lines of numbers to answer from: one for each indicator and district of the year."""
    layer = map_layer(obs, districts, year).where("value is not null")
    line = F.concat_ws(" | ", "indicator_id", "name", amount(F.col("value")), F.coalesce(signed_percent(F.col("yoy")), F.lit("—")))
    return layer.select("indicator_id", "district_id", line.alias("line"))


def insight(obs: DataFrame, districts: DataFrame, year: int) -> DataFrame:
    """Leader, laggard and how many districts decline, of each indicator."""
    return extremes(map_layer(obs, districts, year))


def conversation_texts(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order as one text."""
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(each.alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    return rows.select("conv_id", F.size("turns").alias("n_turns"), F.array_join(said, "\n").alias("text"))
