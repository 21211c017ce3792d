"""What an assistant asks of the numbers: charts, answers and context, for many questions at once.

A question names a module, a district, both or neither.  Everything it may need is worked out
once for all indicators and districts, then joined to the questions by what they name; the
driver sees no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MODULES
from ..functions.numbers import amount, fixed, severity, signed_percent
from ..lineage import cut
from .catalog import primary_indicators
from .map_layer import declining, fastest, leaders_and_laggards, map_layer, to_mean, top_ranked
from .observations import cells_of
from .questions import parsed
from .series import district_series, national_series

MOST_CHARTS = 3


def module_order(module: Column) -> Column:
    """The module's place in the fixed order, last if unknown."""
    places = F.create_map(*[F.lit(x) for name, (*_, place) in MODULES.items() for x in (name, place)])
    return F.coalesce(F.try_element_at(places, module), F.lit(99))


def resolved(requests: DataFrame, indicators: DataFrame, primary: DataFrame, default: bool = False) -> DataFrame:
    """The requests with ``indicator``: the one named by indicator_id, else the primary one of the module.

    An unknown id or module gives none; with ``default`` the primary indicator of the first
    module stands in where there is none.
    """
    named = indicators.select(F.col("id").alias("_named"))
    firsts = primary.select(F.col("module").alias("_module"), F.col("id").alias("_primary"))
    rows = requests.join(named, F.col("indicator_id") == F.col("_named"), "left").join(firsts, F.col("module") == F.col("_module"), "left")
    found = F.when(F.col("indicator_id").isNotNull(), F.col("_named")).otherwise(F.col("_primary"))
    if default:
        first = primary.agg(F.min_by("id", F.struct(module_order(F.col("module")), "module")).alias("id")).first()["id"]
        found = F.coalesce(found, F.lit(first))
    return rows.select(*requests.columns, found.alias("indicator"))


class Figures:
    """The year's map layer, series and primary indicators, each written once."""

    def __init__(self, obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int):
        self.year, self.indicators, self.districts = year, indicators, districts
        cells = cut(cells_of(obs))
        self.primary = cut(primary_indicators(indicators, obs))
        mine = self.primary.select(F.col("id").alias("indicator_id"), "module", "name", "unit")
        self.mine = mine
        self.layer = cut(map_layer(cells, districts, year))
        self.own_layer = self.layer.join(mine.select("indicator_id", "module", F.col("name").alias("title"), "unit"), "indicator_id")
        self.nation = cut(national_series(cells, year_to=year))
        self.districts_series = cut(district_series(cells, year_to=year))
        self.cards = self.nation.where(F.col("year") == year).join(mine, "indicator_id")


def _gathered(rows: DataFrame, keys: list[str], order: Column, *values: Column) -> DataFrame:
    """``items``: the values of each key's rows in order; keys hold one chart's or one answer's rows."""
    item = F.struct(order.alias("place"), F.struct(*values).alias("item"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("items"))


def _part(kind: str, rows: DataFrame) -> DataFrame:
    """kind, indicator_id, district_id (null where the part isn't of one) and items."""
    none = F.lit(None).cast("string")
    own = lambda c: F.col(c) if c in rows.columns else none.alias(c)
    return rows.select(F.lit(kind).alias("kind"), own("indicator_id"), own("district_id"), "items")


#: Kinds of parts that look at no indicator, and those that look at a district.
OF_ALL = ("share", "structure", "district", "overview")
OF_DISTRICT = ("dynamics", "series", "share", "district", "compare")


def _attached(asked: DataFrame, parts: list[DataFrame], how: str) -> DataFrame:
    """``asked`` (kind, indicator, district_id) with the items of the part of its kind, indicator and district."""
    none = F.lit("")
    every = cut(reduce(DataFrame.unionByName, parts)).select(
        F.col("kind").alias("_kind"), F.coalesce("indicator_id", none).alias("_i"), F.coalesce("district_id", none).alias("_d"), "items"
    )
    own = asked.withColumn("_kind", F.col("kind")).withColumn("_i", F.when(F.col("kind").isin(*OF_ALL), none).otherwise(F.col("indicator")))
    own = own.withColumn("_d", F.when(F.col("kind").isin(*OF_DISTRICT), F.coalesce("district_id", none)).otherwise(none))
    return own.join(every, ["_kind", "_i", "_d"], how).drop("_kind", "_i", "_d")


def charts(requests: DataFrame, obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int) -> DataFrame:
    """(id, place, kind, indicator, district_id, points) of the first three requests of each id.

    ``requests`` has id, place, kind, module and district_id.  Kinds are dynamics, ranking,
    growth, share, structure and compare.  Requests that cannot be met (another kind, no
    district where one is needed, too few points) give no row.
    """
    f = Figures(obs, districts, indicators, year)
    turn = Window.partitionBy("id").orderBy("place")
    asked = requests.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= MOST_CHARTS).drop("_n").withColumn("indicator_id", F.lit(None).cast("string"))
    asked = resolved(asked, indicators, f.primary, default=True).drop("indicator_id", "module")
    label, value = lambda c: F.col(c).cast("string").alias("label"), lambda c: F.col(c).alias("value")
    shares = f.own_layer.where("share is not null")
    two = lambda rows: rows.where(F.size("items") >= 2)
    means = to_mean(f.layer).where("value is not null")
    parts = [
        _part("dynamics", two(_gathered(f.nation, ["indicator_id"], F.col("year"), label("label"), value("value")))),
        _part("dynamics", two(_gathered(f.districts_series, ["indicator_id", "district_id"], F.col("year"), label("label"), value("value")))),
        _part("ranking", _gathered(top_ranked(f.layer), ["indicator_id"], F.col("rank"), label("name"), value("value"))),
        _part("growth", _gathered(fastest(f.layer), ["indicator_id"], F.col("place"), label("name"), value("yoy"))),
        _part("share", _gathered(shares, ["district_id"], F.struct(-F.col("share"), F.col("module")), label("module"), value("share"))),
        _part("structure", _gathered(f.cards.where("yoy is not null").withColumn("all", F.lit(1)), ["all"], F.struct(-F.col("yoy"), F.col("module")), label("module"), value("yoy"))),
        _part("compare", _gathered(means.withColumn("side", F.explode(F.array(F.struct(F.lit("local").alias("label"), F.col("value")), F.struct(F.lit("mean").alias("label"), F.col("mean").alias("value"))))),
                                   ["indicator_id", "district_id"], F.col("side.label"), F.col("side.label"), F.col("side.value"))),
    ]
    met = _attached(asked, parts, "inner")
    return met.select("id", "place", "kind", "indicator", "district_id", F.col("items").alias("points"))


def default_charts(obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int, module: str | None = None, district=None) -> DataFrame:
    """The charts shown before anything is asked: dynamics and ranking, and a district's shares or the structure of all."""
    kinds = ["dynamics", "ranking", "share" if district is not None else "structure"]
    rows = [("default", i + 1, kind, module, district) for i, kind in enumerate(kinds)]
    requests = obs.sparkSession.createDataFrame(rows, "id string, place int, kind string, module string, district_id string")
    return charts(requests, obs, districts, indicators, year)


def answers(questions: DataFrame, obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int) -> DataFrame:
    """(id, intent, indicator, district_id, text) of parsed questions (id, intent, district_id, module).

    The figures are those of the primary indicator of the module asked for, else of the first
    module.  Seven intents: recommend and weak name the districts that decline most, compare the
    first and last three, district its modules by share, annual and module the series (of the
    district if one is named), overview the cards of all modules.  Where a question has no
    figures the text says so.
    """
    f = Figures(obs, districts, indicators, year)
    asked = questions.withColumn("indicator_id", F.lit(None).cast("string"))
    asked = resolved(asked, indicators, f.primary, default=True).drop("indicator_id")
    kind = F.when(F.col("intent").isin("annual", "module"), "series").when(F.col("intent").isin("recommend", "weak", "overview"), F.col("intent")).when(F.col("intent") == "compare", "ends")
    kind = F.coalesce(kind, F.when((F.col("intent") == "district") & F.col("district_id").isNotNull(), "district"), F.lit("overview"))
    asked = asked.withColumn("kind", kind)

    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("line")
    grown = F.coalesce(signed_percent(F.col("yoy")), F.lit("—"))
    worst = declining(f.own_layer, 6)
    ends = leaders_and_laggards(f.own_layer)
    shares = f.own_layer.where("share is not null")
    star = F.when(F.col("partial"), F.concat(F.lit(" ["), F.col("caption"), F.lit("]"))).otherwise("")
    point = line(F.col("year").cast("string"), star, ": ", amount(F.col("value")), " (", grown, ")")
    parts = [
        _part("weak", _gathered(worst, ["indicator_id"], F.col("place"), line(F.col("place").cast("string"), ". ", F.col("name"), ": ", amount(F.col("value")), " ", F.col("unit"), ", ", grown))),
        _part("recommend", _gathered(worst.where("place = 1"), ["indicator_id"], F.col("place"), line(F.col("name"), ": ", grown, ", ", severity(F.col("yoy")), ", ", F.col("rank").cast("string"), "-orın"))),
        _part("ends", _gathered(ends, ["indicator_id"], F.struct(F.col("side") == "bottom", F.when(F.col("side") == "top", F.col("rank")).otherwise(-F.col("rank"))),
                                   line(F.col("rank").cast("string"), ". ", F.col("name"), ": ", amount(F.col("value")), " (", fixed(F.col("share")), "%)"))),
        _part("district", _gathered(shares, ["district_id"], F.struct(-F.col("share"), F.col("module")), line(F.col("module"), ": ", fixed(F.col("share")), "%, ", amount(F.col("value")), ", ", grown))),
        _part("series", _gathered(f.nation, ["indicator_id"], F.col("year"), point)),
        _part("series", _gathered(f.districts_series, ["indicator_id", "district_id"], F.col("year"), point)),
        _part("overview", _gathered(f.cards.withColumn("all", F.lit(1)), ["all"], F.struct(module_order(F.col("module")), F.col("module")), line(F.col("module"), ": ", amount(F.col("value")), " ", F.col("unit"), " (", grown, ")"))),
    ]
    told = _attached(asked, parts, "left")
    empty = F.when(F.col("kind").isin("weak", "recommend"), "Barlıq rayonlarda kólem óskan.").otherwise("Maǵlıwmat joq.")
    text = F.coalesce(F.array_join(F.transform("items", lambda x: x["line"]), "\n"), empty)
    return told.select("id", "intent", "indicator", "district_id", text.alias("text"))


def replies(prompts: DataFrame, obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int) -> DataFrame:
    """(id, intent, indicator, district_id, text) of prompts in words (id, prompt): what they ask for, and the answer."""
    return answers(cut(parsed(prompts, districts)), obs, districts, indicators, year)


def context(obs: DataFrame, districts: DataFrame, indicators: DataFrame, year: int, module: str | None = None, district=None) -> DataFrame:
    """(section, place, line): the lines of numbers to answer from, in four sections.

    1: each primary indicator with its districts by rank; 2: the cards of all modules; 3: the
    series of the module's indicator, of the district if one is given; 4: the district's modules.
    Only primary indicators are shown, so the text stays short however many there are.
    """
    f = Figures(obs, districts, indicators, year)
    order = module_order(F.col("module")).cast("long")
    number = lambda c: fixed(F.col(c))
    rows = f.own_layer.where("value is not null")
    head = rows.select("module", "title", "unit").distinct().select(F.lit(1).alias("section"), (order * 100_000).alias("place"), F.concat(F.lit("### "), "title", F.lit(" ("), "unit", F.lit(")")).alias("line"))
    body = rows.select(F.lit(1).alias("section"), (order * 100_000 + F.col("rank")).alias("place"), F.concat_ws(" | ", "name", number("value"), number("yoy"), number("share"), F.col("rank").cast("string")).alias("line"))
    cards = f.cards.select(F.lit(2).alias("section"), order.alias("place"), F.concat(F.lit("- "), "name", F.lit(": "), number("value"), F.lit(" "), "unit", F.lit(" ("), number("yoy"), F.lit("%)")).alias("line"))
    out = head.unionByName(body).unionByName(cards)
    if module is not None:
        series = f.nation if district is None else f.districts_series.where(F.col("district_id") == district)
        own = series.join(f.mine.where(F.col("module") == module).select("indicator_id"), "indicator_id")
        star = F.when(F.col("partial"), F.concat(F.lit(" ["), F.col("caption"), F.lit("]"))).otherwise("")
        text = F.concat(F.lit("- "), F.col("year").cast("string"), star, F.lit(": "), number("value"), F.lit(" ("), number("yoy"), F.lit("%)"))
        out = out.unionByName(own.select(F.lit(3).alias("section"), F.col("year").cast("long").alias("place"), text.alias("line")))
    if district is not None:
        of = rows.groupBy("indicator_id").agg(F.count("*").alias("of"))
        mine = rows.where(F.col("district_id") == district).join(of, "indicator_id")
        text = F.concat(F.lit("- "), "title", F.lit(": "), number("value"), F.lit(" "), "unit", F.lit(", "), number("share"), F.lit("%, "), F.col("rank").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(", "), number("yoy"), F.lit("%"))
        out = out.unionByName(mine.select(F.lit(4).alias("section"), order.alias("place"), text.alias("line")))
    return out


def question_rows(plans: DataFrame, year: int | None = None, region=None, module=None, limit: int = 50) -> DataFrame:
    """The plan rows that a free question is answered from: equal year, region and module where given, the first by id."""
    for name, value in (("year", year), ("region", region), ("module", module)):
        if value is not None:
            plans = plans.where(F.col(name) == value)
    return plans.orderBy("id").limit(limit)


def question_text(rows: DataFrame) -> DataFrame:
    """One text of ``question_rows``: a line for each, or that there is no data."""
    line = F.concat_ws(" | ", F.coalesce("module", F.lit("—")), F.coalesce("region", F.lit("—")), fixed(F.col("planned")), fixed(F.col("actual")), F.col("status"))
    each = F.sort_array(F.collect_list(F.struct("id", line.alias("line"))))  # at most the limit
    text = F.array_join(F.transform(each, lambda x: x["line"]), "\n")
    return rows.agg(F.count("*").alias("rows"), F.when(F.count("*") > 0, text).otherwise("Maǵlıwmat joq.").alias("text"))

