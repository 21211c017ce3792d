"""What has no SQL, against plain Python: text forms, intents, forecasts, files, databases, saved models."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.constants import INTENT_KEYWORDS, MODULE_KEYWORDS, SEARCH_LETTERS
from statloom.functions import text
from statloom.operators import forecasting, models, questions, shapes
from statloom.plans import catalogue, tables
from statloom.sources import files
from tests.test_sources import workbook

SF = "/root/testdata/sf0.001"


def plain_form(t: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return "".join(SEARCH_LETTERS.get(c, c) for c in plain)


def test_search_forms(spark):
    said = {(r["conv_id"], r["turn"]): r["text"] for r in tables.read(spark, SF, "conversations").collect()}
    found = {(r["conv_id"], r["turn"]): r["form"] for r in catalogue.QUERIES["search_forms"](spark, SF).collect()}
    assert found == {k: plain_form(t) for k, t in said.items()} and len(found) > 50
    words = ["Ǵárezsiz Qaraqalpaqstan", "Mo'ynoq ʻ’`", "ÁÓÚŃ ﬁ", ""]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "t string").select(text.search_form(F.col("t"))).collect()
    assert [r[0] for r in rows] == [*map(plain_form, words), None]


def test_slugs(spark):
    found = {r["p_partkey"]: r["slug"] for r in catalogue.QUERIES["slugs"](spark, SF).collect()}
    for r in tables.read(spark, SF, "part").collect():
        whole = f"{r['p_name']}|{r['p_brand']}"
        kept = re.sub(r"[^a-z0-9]+", " ", plain_form(whole)).split()
        assert found[r["p_partkey"]] == "-".join(kept)[:100].strip("-") + "-" + hashlib.blake2s(whole.encode(), digest_size=4).hexdigest()


def plain_question(t: str) -> str:
    return " ".join(re.sub(r"[^\w\s]+", " ", plain_form(t)).split())


def plain_intent(prompt: str, districts: list) -> tuple:
    q, best = plain_question(prompt), (0, None)
    for ident, *names in sorted(districts):
        for alias in map(plain_question, [*names, ident]):
            n = max([i for i in range(5, len(alias) + 1) if alias[:i] in q], default=0) if len(alias) >= 4 else 0
            if n > best[0]:
                best = (n, ident)
    first = lambda named: next((k for k, keys in named.items() if any(re.search(r"\b" + re.escape(plain_question(x)), q) for x in keys)), None)
    module = first(MODULE_KEYWORDS)
    rest = "module" if module else "district" if best[1] else "overview"
    return first(INTENT_KEYWORDS) or rest, best[1], module


def test_question_intents(spark):
    districts = [(r["district_id"], r["name"], r["name_ru"]) for r in tables.districts(spark, SF).collect()]
    asked = {f"{r['conv_id']}-{r['turn']}": r["text"] for r in tables.read(spark, SF, "conversations").where("role = 'user'").collect()}
    found = {r["id"]: (r["intent"], r["district_id"], r["module"]) for r in catalogue.QUERIES["question_intents"](spark, SF).collect()}
    assert found == {i: plain_intent(p, districts) for i, p in asked.items()}
    places = [("moynoq", "Moynaq", "Муйнак"), ("nukus-shahri", "Nókis qalası", "город Нукус"), ("nukus-tumani", "Nókis rayonı", "Нукусский район")]
    prompts = ["Moynaqta sanaat qalay?", "Nókis qalasında mashqala bar ma", "Xojayli jaǵdayı", "eń jaqsı rayon qaysı", "jıllıq juwmaq", "Нукусский район", "nokis", "ne islew kerek, qurılıs"]
    df = spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")
    names = spark.createDataFrame(places, "district_id string, name string, name_ru string")
    rows = {r["id"]: (r["intent"], r["district_id"], r["module"]) for r in questions.parsed(df, names).collect()}
    assert rows == {i: plain_intent(p, places) for i, p in enumerate(prompts)}


def test_trend_forecasts_follow_a_growth(spark):
    rows = [(k, 2000 + i, 100.0 * g**i) for k, g in (("a", 1.1), ("b", 0.9)) for i in range(8)] + [("few", 2000, 1.0), ("down", 2000, -1.0), ("down", 2001, -3.0), ("down", 2002, -5.0)]
    out = models.trend_forecast(spark.createDataFrame(rows, "k string, year int, v double"), "k", "v", 3).collect()
    found = {(r["k"], r["year"]): r["yhat"] for r in out}
    assert all(found[k, 2007 + s] == pytest.approx(100 * g ** (7 + s)) for k, g in (("a", 1.1), ("b", 0.9)) for s in (1, 2, 3))
    assert found["down", 2003] == pytest.approx(-7) and not any(k == "few" for k, _ in found)
    every = catalogue.QUERIES["trend_forecasts"](spark, SF).collect()
    panel = {(r["district_id"], r["year"]): r["active"] for r in tables.panel(spark, SF).collect()}
    for r in every[:40]:
        years = sorted(y for d, y in panel if d == r["district_id"])
        slope, start = np.polyfit(years, np.log([panel[r["district_id"], y] for y in years]), 1)
        assert r["yhat"] == pytest.approx(np.exp(slope * r["year"] + start)) and r["lower"] <= r["yhat"] <= r["upper"]


def test_autoregression_continues_what_it_has_seen(spark):
    steady = [("s", 2000 + i, 5.0 * i, float(i)) for i in range(12)]
    wave = [("w", 2000 + i, 50 + 40 * 0.8**i, float(i)) for i in range(14)]
    df = spark.createDataFrame(steady + wave + [("few", 2000, 1.0, 1.0)], "k string, year int, v double, x double")
    found = {(r["k"], r["year"]): r for r in models.autoregressive_forecast(df, "k", "v", 2).collect()}
    assert found["s", 2012]["yhat"] == pytest.approx(60, rel=0.03) and found["w", 2014]["yhat"] == pytest.approx(50 + 40 * 0.8**14, rel=0.03)
    assert all(r["lower"] <= r["upper"] for r in found.values()) and ("few", 2001) not in found
    driven = models.autoregressive_forecast(df.where("k <> 'few'"), "k", "v", 2, ["x"]).collect()
    assert {(r["k"], r["year"]) for r in driven} == {("s", 2012), ("s", 2013), ("w", 2014), ("w", 2015)}


def test_forecast_dispatcher(spark):
    wide = spark.createDataFrame([(2010 + i, 10.0 + i, 5.0 + 2 * i, 7.0 + i, 3.0, 8.0 if i < 4 else None, float(i)) for i in range(8)], "year int, export double, investment double, services double, other double, short double, plain double")
    drivers = forecasting.DRIVERS | {"short": ("recurrent", ()), "plain": ("line", ())}
    out = forecasting.forecast(wide, steps=40, drivers=drivers).collect()
    assert {(r["indicator"], r["model"]) for r in out} == {("export", "recurrent"), ("investment", "recurrent"), ("services", "ensemble"), ("other", "changepoints"), ("short", "changepoints"), ("plain", "line")}
    assert all(sum(r["indicator"] == i for r in out) == 10 for i in ("export", "other", "services", "short"))
    assert all(r["lower"] <= r["upper"] for r in out)
    assert forecasting.forecast(wide, "unknown").count() == 0
    assert forecasting.forecast(wide.where("year < 2012"), "export", 2).count() == 0
    short = forecasting.forecast(wide.where("year < 2013"), "export", 2).collect()
    assert [r["model"] for r in short] == ["changepoints", "changepoints"]


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = [(str(i % 5), 2000 + i // 5, float(i % 3), *[float(i + j) for j in range(9)]) for i in range(30)]
    df = spark.createDataFrame(rows, "district_id string, year int, label double, " + ", ".join(f"{c} double" for c in models.FEATURES[:9]))
    df = df.withColumn(models.FEATURES[9], F.col("year") - 2000.0)
    model = models.early_warning(df, trees=3)
    models.save(model, str(tmp_path / "model"))
    again = models.loaded(str(tmp_path / "model"))
    assert models.warned(again, df).orderBy("year", "district_id").collect() == models.warned(model, df).orderBy("year", "district_id").collect()
    scores = models.cross_validated(df, "district_id", 2)
    boosted = models.cross_validated(df, "district_id", 2, lambda rows: models.boosted_warning(rows, 4, rate=0.5))
    assert boosted.count() == 2 and scores.count() == 2 and models.score_summary(scores, "macro_f1").first()["n"] == 2


def test_database_tables(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    files.write_jdbc(df, url, "names", driver="org.apache.derby.jdbc.EmbeddedDriver")
    files.write_jdbc(df.where("id < 3"), url, "names", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = files.read_jdbc(spark, url, "names", "id", 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and back.count() == 53 and back.where("id = 2").count() == 2
    assert files.read_jdbc(spark, url, "names", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 53


def test_workbooks_are_found_and_loaded(spark, tmp_path):
    grid = [["region", "module", "year", "kpi_planned", "other"], ["r1", "m1", 2024, 10.5, "x"], ["r2", None, 2024, 1, None], ["r3", "m2", "abc", 2, None]]
    workbook(tmp_path / "b" / "Plans 2.xlsx", grid)
    workbook(tmp_path / "a" / "other.xlsx", grid)
    workbook(tmp_path / "00_Duplikatlar" / "plans.xlsx", grid)
    (tmp_path / "a" / "plans.txt").write_text("x")
    assert [r["name"] for r in files.find_workbooks(spark, str(tmp_path)).collect()] == ["other.xlsx", "Plans 2.xlsx"]
    assert [r["path"].rsplit("/", 2)[-2] for r in files.find_workbooks(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert files.find_workbooks(spark, str(tmp_path), "PLANS").count() == 1
    good, bad = files.bulk_workbooks(spark, str(tmp_path / "b"))
    assert [(r["region"], r["year"], r["kpi_planned"], r["status"]) for r in good.collect()] == [("r1", 2024, 10.5, "in_progress")]
    assert sorted(r["error"] for r in bad.collect()) == ["module is empty", "year: abc"]


def test_shapes_of_a_drawing(spark, tmp_path):
    (tmp_path / "map.svg").write_text('<svg viewBox="0 0 10 10"><path d="M0 0 H4 V4 H0 Z"/><g><path id="p" d="M5,5 L9,5 L9,9 L5,9 Z"/></g></svg>')
    rows = files.svg_paths(spark, str(tmp_path / "map.svg")).withColumn("id", F.col("place")).withColumn("ring", shapes.path_points(F.col("d")))
    assert [r["view"] for r in rows.collect()] == ["0 0 10 10"] * 2
    boxes = shapes.bounding_boxes(rows, "id")
    labels = shapes.label_points(rows.select("id", "ring"), "id").select("id", F.col("x").alias("label_x"), F.col("y").alias("label_y"))
    shown = rows.select("id", "d").join(boxes, "id").join(labels, "id")
    said = files.geometry_text(shown).first()["text"].split("\n")
    assert said[0] == "export const SHAPES = [" and said[-1] == "];"
    assert said[2] == '  { id: "1", labelX: 7.0, labelY: 7.0, bbox: [5.0, 5.0, 9.0, 9.0], d: "M5,5 L9,5 L9,9 L5,9 Z" },'


def test_a_bad_sheet_is_passed_over(spark, tmp_path):
    import zipfile

    from statloom.sources.workbook import sheets

    workbook(tmp_path / "g.xlsx", [["a", 1]])
    data = (tmp_path / "g.xlsx").read_bytes()
    bad = tmp_path / "bad.xlsx"
    with zipfile.ZipFile(tmp_path / "g.xlsx") as old, zipfile.ZipFile(bad, "w") as new:
        for name in old.namelist():
            content = old.read(name)
            new.writestr(name, re.sub(rb"<v>1(\.0)?</v>", b"<v>one</v>", content) if "sheet" in name else content)
    assert sheets(data)[0][1] and (sheets(bad.read_bytes()) == [] or sheets(bad.read_bytes())[0][1])
