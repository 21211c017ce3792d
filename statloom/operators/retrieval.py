"""Figures that a question asks for, and questions with answers made from figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOPIC_KEYWORDS
from ..functions.numbers import double, fixed
from ..functions.text import last_year_in, question_form
from ..lineage import broadcast_if_small, cut
from .questions import places_named

#: Topics whose figures are not among the macro ones.
UNEMPLOYMENT, WAGES = "Jumıssızlıq", "IsHaqı"


def topics(text: Column) -> Column:
    """The topics whose keywords the text holds, in order, each once; JAO without any."""
    low = F.lower(text)
    found = F.array(*[F.when(F.contains(low, F.lit(k)), t) for k, t in TOPIC_KEYWORDS.items()])
    named = F.array_distinct(F.filter(found, lambda t: t.isNotNull()))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("JAO")))


def figures(questions: DataFrame, macro: DataFrame, last: int = 4) -> DataFrame:
    """(id, indicator, year, value): for each topic of a question its year, or its last years if none is named."""
    asked = questions.select("id", F.explode(topics(F.col("prompt"))).alias("indicator"), last_year_in(F.col("prompt")).alias("asked"))
    back = Window.partitionBy("indicator").orderBy(F.desc("year"))
    values = macro.withColumn("back", F.row_number().over(back))
    rows = asked.join(values, "indicator")
    wanted = F.when(F.col("asked").isNotNull(), F.col("year") == F.col("asked")).otherwise(F.col("back") <= last)
    return rows.where(wanted).select("id", "indicator", "year", "value")


def contexts(questions: DataFrame, macro: DataFrame, labour: DataFrame, wages: DataFrame, districts: DataFrame, total, branch: str, last: int = 4) -> DataFrame:
    """(id, section, topic, item, at, value): all figures that questions (id, prompt) ask for, in four sections.

    ``macro`` (indicator, year, value): the year asked where the topic has it, else its last years.
    ``labour`` (district_id, year, active, employed, unemployed, rate): where unemployment is asked,
    that of the district named, else of ``total``, in the year asked or its last.  ``districts``:
    where one is named, the rates of all in the year asked or the last.  ``wages`` (branch, year,
    quarter, value): where asked, the last quarters of ``branch``, in thousands.  Values are rounded
    as they are shown.  Questions with equal ids are one question; a null prompt is an empty one.
    """
    text = F.coalesce(F.col("prompt"), F.lit(""))
    asked = cut(questions.select("id", topics(text).alias("topics"), last_year_in(text).alias("asked"), question_form(text).alias("q")).dropDuplicates(["id"]))
    named = places_named(asked.select("id", "q"), districts).withColumnRenamed("district_id", "named")
    each = asked.select("id", "asked", F.explode("topics").alias("topic"))
    out = lambda rows, section, topic, item, at, value: rows.select("id", F.lit(section).alias("section"), topic.alias("topic"), item.alias("item"), at.cast("string").alias("at"), value.cast("double").alias("value"))

    back = Window.partitionBy("indicator").orderBy(F.desc("year"))
    known = macro.where("value is not null").select("indicator", "year", "value").withColumn("back", F.row_number().over(back))
    rows = each.join(broadcast_if_small(known), F.col("topic") == F.col("indicator"))
    there = F.max(F.coalesce(F.col("year") == F.col("asked"), F.lit(False))).over(Window.partitionBy("id", "topic"))
    rows = rows.withColumn("there", there).where(F.when(F.col("there"), F.col("year") == F.col("asked")).otherwise(F.col("back") <= last))
    parts = [out(rows, "macro", F.col("topic"), F.when(F.col("there"), "value").otherwise("series"), F.col("year"), F.round(double(F.col("value")), 2))]

    own = labour.select(F.col("district_id").alias("place"), F.col("year").alias("of"), "active", "employed", "unemployed", "rate")
    ends = own.groupBy("place").agg(F.max("of").alias("latest"))
    about = each.where(F.col("topic") == UNEMPLOYMENT).join(named, "id", "left").withColumn("place", F.coalesce("named", F.lit(total))).drop("named")
    found = about.join(broadcast_if_small(own.join(ends, "place")), "place").where(F.col("of") == F.coalesce("asked", "latest"))
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.round(double(F.col(c)), d).alias("value")) for c, d in (("active", 1), ("employed", 1), ("unemployed", 1), ("rate", 2))])
    found = found.select("id", F.concat_ws(" ", "place", F.col("of").cast("string")).alias("at"), F.inline(items))
    parts.append(out(found, "labour", F.lit(UNEMPLOYMENT), F.col("item"), F.col("at"), F.col("value")))

    newest = labour.agg(F.max("year")).first()[0]  # one number
    wanted = asked.select("id", "asked").join(named.select("id"), "id").withColumn("of", F.coalesce("asked", F.lit(newest)))
    beside = wanted.join(broadcast_if_small(own.where("rate is not null")), "of")
    parts.append(out(beside, "districts", F.lit(UNEMPLOYMENT), F.col("place"), F.col("of"), F.round(double(F.col("rate")), 2)))

    latest = Window.orderBy(F.desc("year"), F.desc("quarter"))  # the quarters of one branch
    paid = wages.where((F.col("branch") == branch) & F.col("value").isNotNull()).withColumn("back", F.row_number().over(latest)).where(F.col("back") <= last)
    quarter = F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))
    money = each.where(F.col("topic") == WAGES).select("id").crossJoin(F.broadcast(paid))  # four rows
    parts.append(out(money, "wages", F.lit(WAGES), F.lit(branch), quarter, F.round(double(F.col("value")) / 1000, 0)))
    return reduce(DataFrame.unionByName, parts)


def _lines(context: DataFrame) -> DataFrame:
    """(id, place, line): the lines that tell a context, in order."""
    number = fixed(F.col("value"))
    which = {"macro": 1, "labour": 2, "districts": 3, "wages": 4}
    order = F.create_map(*[F.lit(x) for pair in which.items() for x in pair])[F.col("section")]
    worst = F.row_number().over(Window.partitionBy("id", "section").orderBy(F.desc("value"), "item"))
    newest = F.row_number().over(Window.partitionBy("id", "section", "topic").orderBy(F.desc("at")))
    rows = context.withColumn("worst", F.when(F.col("section") == "districts", worst)).withColumn("newest", newest)
    rows = rows.where(F.when(F.col("section") == "districts", F.col("worst") <= 3).when(F.col("item") == "series", F.col("newest") <= 3).otherwise(True))
    unit = F.when(F.col("section") == "macro", unit_of(F.col("topic"))).when(F.col("section") == "wages", "mıń som").when((F.col("section") == "labour") & (F.col("item") != "rate"), "mıń").otherwise("%")
    said = F.concat(F.lit("- "), F.col("topic"), F.when(F.col("section").isin("labour", "districts"), F.concat(F.lit(" "), F.col("item"))).otherwise(""), F.lit(" ("), F.col("at"), F.lit("): "), number, F.lit(" "), unit)
    place = F.struct(order.alias("section"), F.col("topic").alias("topic"), F.coalesce("worst", F.lit(0)).alias("worst"), F.col("at").alias("at"), F.col("item").alias("item"))
    return rows.select("id", place.alias("place"), said.alias("line"))


def told(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(id, prompt, answer): for each question (id, prompt) the prompt to a model, with its figures, and the answer made from a template alone."""
    lines = _lines(context).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))  # some dozen a question
    rows = questions.select("id", "prompt").dropDuplicates(["id"]).join(lines, "id", "left")
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("Maǵlıwmat tabılmadı."))
    prompt = F.concat(F.lit("=== Maǵlıwmatlar ===\n"), body, F.lit("\n\n=== Soraw ===\n"), F.coalesce("prompt", F.lit("")))
    answer = F.concat(F.lit("## Statistika\n"), body, F.lit("\n\n## Juwmaq\n"), F.when(F.col("lines").isNull(), "Sorawdı anıqlań.").otherwise("Sanlar bazadan alındı."))
    return rows.select("id", prompt.alias("prompt"), answer.alias("answer"))


def unit_of(indicator: Column) -> Column:
    return F.when(indicator.isin("Eksport", "Import", "Saldo"), "mln.$").otherwise("mlrd.som")


def training_pairs(macro: DataFrame) -> DataFrame:
    """Questions with answers about values, growth and shares of the first indicator, for fine-tuning."""
    before = macro.select("indicator", (F.col("year") + 1).alias("year"), F.col("value").alias("base"))
    whole = macro.where("indicator = 'JAO'").select("year", F.col("value").alias("whole"))
    rows = macro.join(before, ["indicator", "year"], "left").join(whole, "year", "left").withColumn("unit", unit_of(F.col("indicator")))
    number = fixed
    name, year = F.col("indicator"), F.col("year").cast("string")
    value = F.struct(F.concat(name, F.lit(" "), year, F.lit("?")).alias("human"), F.concat_ws(" ", name, F.concat(year, F.lit(":")), number(F.col("value")), "unit").alias("gpt"))
    grown = (F.col("value") - F.col("base")) / F.nullif(F.abs("base"), F.lit(0.0)) * 100
    growth = F.when(grown.isNotNull(), F.struct(F.concat(name, F.lit(" "), year, F.lit(" ósim?")).alias("human"), F.concat(number(grown), F.lit("%")).alias("gpt")))
    part = F.when(name != "JAO", F.col("value") / F.nullif(F.col("whole"), F.lit(0.0)) * 100)
    share = F.when(part.isNotNull(), F.struct(F.concat(name, F.lit(" "), year, F.lit(" úlesi?")).alias("human"), F.concat(number(part), F.lit("%")).alias("gpt")))
    return rows.select("indicator", "year", F.inline(F.filter(F.array(value, growth, share), lambda x: x.isNotNull())))


def _said(kind: str, rows: DataFrame, human: Column, gpt: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), human.alias("human"), gpt.alias("gpt"))


def generated(macro: DataFrame, labour: DataFrame) -> DataFrame:
    """(kind, human, gpt): questions with answers from macro figures (indicator, year, value) and labour (district_id, year, active, rate).

    Ten kinds: value, growth and share of each figure; change from the first to the last year, the
    highest and lowest year, and the mean of the last three growth rates of each indicator; the
    balance of trade by year; the largest indicator by year; the rate of each district and year;
    the best and worst district by year.
    """
    text, number = lambda c: F.col(c).cast("string"), fixed
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    pairs = training_pairs(macro)
    kind = F.when(F.endswith("human", F.lit(" ósim?")), "growth").when(F.endswith("human", F.lit(" úlesi?")), "share").otherwise("value")
    every = [pairs.select(kind.alias("kind"), "human", "gpt")]

    ends = macro.groupBy("indicator").agg(
        F.min("year").alias("a"), F.max("year").alias("b"), F.min_by("value", "year").alias("va"), F.max_by("value", "year").alias("vb"),
        F.max_by("year", F.struct(F.col("value"), -F.col("year"))).alias("top"), F.min_by("year", F.struct("value", "year")).alias("low"),
    ).where("a < b")
    times = F.col("vb") / F.nullif(F.col("va"), F.lit(0.0))
    every.append(_said("change", ends, say(F.col("indicator"), " ", text("a"), "–", text("b"), "?"), say(number(F.col("va")), " → ", number(F.col("vb")), " (", number(times), " ese)")))
    every.append(_said("extremes", ends, say(F.col("indicator"), " eń joqarı?"), say(text("top"), ", ", text("low"))))
    line = Window.partitionBy("indicator").orderBy("year")
    grown = macro.withColumn("g", (F.col("value") - F.lag("value").over(line)) / F.nullif(F.abs(F.lag("value").over(line)), F.lit(0.0)) * 100)
    grown = grown.withColumn("back", F.row_number().over(Window.partitionBy("indicator").orderBy(F.desc("year")))).where("back <= 3")
    means = grown.groupBy("indicator").agg(F.avg("g").alias("g")).where("g is not null")
    every.append(_said("mean_growth", means, say(F.col("indicator"), " ortasha ósim?"), say(number(F.col("g")), "%")))
    side = lambda name, alias: macro.where(F.col("indicator") == name).select("year", F.col("value").alias(alias))
    trade = side("Eksport", "x").join(side("Import", "m"), "year")
    every.append(_said("trade", trade, say("Saldo ", text("year"), "?"), say(number(F.col("x") - F.col("m")), F.when(F.col("x") > F.col("m"), " artıqsha").otherwise(" kemshilik"))))
    largest = macro.groupBy("year").agg(F.max_by("indicator", F.struct("value", "indicator")).alias("i"))
    every.append(_said("largest", largest, say(text("year"), " eń úlken?"), F.col("i")))
    known = labour.where("rate is not null")
    every.append(_said("rate", known, say(F.col("district_id"), " ", text("year"), " jumıssızlıq?"), say(number(F.col("rate")), "%, ", text("active"))))
    best = known.groupBy("year").agg(F.min_by("district_id", F.struct("rate", "district_id")).alias("least"), F.max_by("district_id", F.struct("rate", "district_id")).alias("most"))
    every.append(_said("districts", best, say(text("year"), " eń jaqsı rayon?"), say(F.col("least"), ", ", F.col("most"))))
    return reduce(DataFrame.unionByName, every)


def prompt_text(instructions: str, lines: DataFrame, order: str = "line") -> DataFrame:
    """One text: the instructions and the lines below them, for few lines."""
    return lines.agg(F.concat(F.lit(instructions + "\n"), F.array_join(F.array_sort(F.collect_list(F.col(order))), "\n")).alias("prompt"))


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables (year, value) as one long table with ``part``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), "year", "value") for name, df in parts.items()])
