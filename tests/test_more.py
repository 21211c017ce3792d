"""Reports, uploads, fixed-layout sheets, colours, reference dimensions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statloom.functions import colour
from statloom.operators import load, models, reference, reports, retrieval
from statloom.sources import domain, files, grammar
from tests.test_sources import workbook


def cells(spark, grid):
    rows = [("s", "c", "f", r, c, str(v)) for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, grammar.CELLS)


def test_macro(spark):
    grid = [
        ["Makro"], [None], [None, None, "2010 j.", "2011 j."],
        ["Jalpı aymaqlıq ónim", "mlrd. som", 1, 2], [None, "ósim páti, %", 105, 106], ["Eksport", "mln. dollar", 3, "4,5"], [None, "mln. dollar", 9, 9], ["Basqa", "mlrd.", 7, 7],
    ]
    found = sorted(map(tuple, domain.macro(cells(spark, grid)).collect()))
    assert found == [(2010, "Eksport", 3.0), (2010, "JAO", 1.0), (2011, "Eksport", 4.5), (2011, "JAO", 2.0)]


def test_labour(spark):
    grid = [["x"], ["x"], [None, "2025 й.", None, None, None, "2024 й."], ["x"], ["x"], ["Nukus sh.", 10, 9, 1, 5.5, 8, 7, 1, None], ["Nukus", 4, 3, 1, 6, 4, 3, 1, 7], ["Jámi", 1, 1, 1, 1]]
    found = sorted((r["district_id"], r["year"], r["rate"]) for r in domain.labour(cells(spark, grid)).collect())
    assert found == [("Nukus qalası", 2025, 5.5), ("Nukus tumani", 2024, 7.0), ("Nukus tumani", 2025, 6.0)]


def test_wages_and_branches(spark):
    grid = [["Is haqı"], [None, "2018Q1", "2018Q2", "2018Q3", "2018Q4"], ["Sanaat", 1, 2, "-", 4]]
    assert sorted(map(tuple, domain.wages(cells(spark, grid)).collect())) == [("Sanaat", 2018, 1, 1.0), ("Sanaat", 2018, 2, 2.0), ("Sanaat", 2018, 4, 4.0)]
    years = [None, *[f"{y} j." for y in range(2010, 2018)]]
    rows = domain.branches(cells(spark, [["t"], years, ["A", *range(1, 9)], ["B", *range(0, 8)], ["* note", *range(1, 9)]]))
    assert {r["branch"] for r in rows.collect()} == {"A"} and rows.count() == 8


def test_colours(spark):
    rows = spark.createDataFrame([(None, None), (0.0, -20.0), (1.0, 0.0), (0.25, 99.0)], "i double, y double")
    found = [tuple(r) for r in rows.select(colour.volume(F.col("i")), colour.growth(F.col("y"))).collect()]
    assert found[0] == ("#1b2338", "#5a6588") and found[1][0] == "#1e294a" and found[2][0] == "#7de2e7" and found[3][0] == "#1a7ab2"


def test_reference_dimensions(spark):
    assert reference.districts(spark).count() == 17 and reference.modules(spark).count() == 7
    cats = reference.categories(spark)
    assert cats.count() == 15 and cats.where("id = 'xaliq'").first()["folders"] == ["09_Xal_q", "09_Xaliq"]
    old = spark.createDataFrame([("makro", "old"), ("own", "own")], "id string, name string")
    assert {tuple(r) for r in reference.seeded(old, cats.select("id", "name").where("id = 'makro'"), "id").collect()} == {("makro", "Makroekonomika"), ("own", "own")}


def test_load_is_idempotent(spark, tmp_path):
    grid = [["Investitsiyalar kólemi, mlrd. som"], [None, "2020", "2021", "2022"], ["Beruniy", 1, 2, 3], ["Xojeli", 4, 5, 6], ["Kegeyli", 7, 8, 9]]
    workbook(tmp_path / "04_Investitsiya" / "w.xlsx", grid)
    data = (tmp_path / "04_Investitsiya" / "w.xlsx").read_bytes()
    known = ["04_Investitsiya"]
    rows = grammar.upload(spark, data, "04_Investitsiya", "w.xlsx", known).withColumn("key", load.record_key()).cache()
    new = load.indicators_of(rows, "key")
    none = spark.createDataFrame([], "key string, id int")
    first = load.with_ids(new, none, "key").cache()
    again = load.with_ids(new, first, "key")
    assert {(r["key"], r["id"]) for r in first.collect()} == {(r["key"], r["id"]) for r in again.collect()} and first.first()["has_districts"]
    stats = load.load_statistics(rows, reference.districts(spark), "key").first()
    assert (stats["added"], stats["skipped"], stats["indicators"]) == (9, 0, 1)
    for wrong in (("x", "w.xlsx"), ("04_Investitsiya", "w.txt")):
        with pytest.raises(ValueError):
            grammar.upload(spark, data, *wrong, known)
    workbook(tmp_path / "e" / "w.xlsx", [["nothing"]])
    with pytest.raises(ValueError):
        grammar.upload(spark, (tmp_path / "e" / "w.xlsx").read_bytes(), "04_Investitsiya", "w.xlsx", known)


def test_rebinding(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False)], "id int, module string, has_districts boolean")
    assert {r["id"]: r["module"] for r in load.rebound(rows, 1, "b", ["a", "b"]).collect()} == {1: "b", 2: "a"}
    assert {r["id"]: r["module"] for r in load.rebound(rows, 2, "b", ["a", "b"]).collect()} == {1: "a", 2: "a"}
    with pytest.raises(ValueError):
        load.rebound(rows, 1, "c", ["a", "b"])


def test_reports(spark, tmp_path):
    panel = spark.createDataFrame(
        [(f"d{i}", y, 1000 + i, 900 + i, 100, 4.0 + (i * 7 + y * 3) % 8) for i in range(9) for y in range(2018, 2026)],
        "district_id string, year int, active int, employed int, unemployed int, rate double",
    )
    fit = lambda rows: models.boosted_warning(rows, 6, rate=0.5)
    worst = reports.weak_spots(panel, fit=fit).collect()
    assert {r["year"] for r in worst} == {2025} and [r["p2"] for r in worst] == sorted((r["p2"] for r in worst), reverse=True)
    assert reports.weak_spots(panel, 2024, fit=models.early_warning).count() > 0
    held = reports.holdout(panel, "district_id", "active", [2024, 2025]).collect()
    assert len(held) == 9 and all(r["mape"] < 1 for r in held)
    done, failed = reports.run_isolated({"good": lambda: panel.limit(1), "bad": lambda: panel.select(F.raise_error(F.lit("no")))})
    assert list(done) == ["good"] and list(failed) == ["bad"]
    text = files.report(rows=panel.limit(2), one=panel.limit(1)).first()["report"]
    assert text.count("district_id") == 3
    files.write_csv(panel.limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_retrieval(spark):
    macro = spark.createDataFrame([("JAO", y, float(y)) for y in range(2015, 2021)] + [("Eksport", 2020, 1.0)], "indicator string, year int, value double")
    asked = spark.createDataFrame([(1, "GDP 2016?"), (2, "eksport")], "id int, prompt string")
    found = {(r["id"], r["indicator"], r["year"]) for r in retrieval.figures(asked, macro).collect()}
    assert found == {(1, "JAO", 2016), (2, "Eksport", 2020)}
    assert retrieval.training_pairs(macro).count() == 6 + 5 + 1 + 1


def test_dialogues(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}]')
    assert [tuple(r) for r in files.dialogues(spark, str(tmp_path / "d.json")).collect()] == [("", "q", "a")]


def test_stages_run_together_and_a_late_one_is_cancelled(spark):
    import time

    from statloom.lineage import scratch

    slow = spark.range(4).repartition(2).mapInPandas(_sleeping, "id long")
    began = time.monotonic()
    done, failed = reports.run_isolated({"quick": lambda: spark.range(10), "slow": lambda: slow, "other": lambda: spark.range(3), "bad": lambda: spark.range(1).select(F.raise_error(F.lit("no")))}, seconds=8)
    assert time.monotonic() - began < 40
    assert list(done) == ["quick", "other"] and done["quick"].count() == 10
    assert list(failed) == ["slow", "bad"] and failed["slow"].startswith("late")
    files_of = done["quick"].inputFiles()
    reports.release(done)
    assert not done and files_of and not any(spark.read.format("binaryFile").option("pathGlobFilter", f.rpartition("/")[2]).load(scratch(spark, "x").rpartition("/")[0]).count() for f in files_of[:1])


def _sleeping(frames):
    import time

    for frame in frames:
        time.sleep(300)
        yield frame


def test_loading_counts_what_it_writes(spark, tmp_path):
    kinds = "ord long, slug string, district_id string, year int, period string, period_no int, value double, indicator string, unit string, category string, source string"
    row = lambda i, slug, d, v=1.0: (i, slug, d, 2020, "year", None, v, slug, "", "c", "s")
    records = spark.createDataFrame([row(1, "a", "x"), row(2, "a", "x", 2.0), row(3, "b", "unknown"), row(4, "c", None)], kinds)
    places = spark.createDataFrame([("x",)], "district_id string")
    old = spark.createDataFrame([("a", 7, "was"), ("z", 9, "z")], "slug string, id long, name string")
    held = spark.createDataFrame([(7, "x", 1999, "year", None, 5.0), (9, "x", 1999, "year", None, 6.0)], "indicator_id long, district_id string, year int, period string, period_no int, value double")
    full = load.load(records, places, old, held, "slug", str(tmp_path / "full"), True)
    assert full == {"categories": 1, "indicators": 3, "added": 2, "skipped": 2, "orphans": 2}
    kept = {r["slug"]: (r["id"], r["name"]) for r in spark.read.parquet(str(tmp_path / "full" / "indicators")).collect()}
    assert kept == {"a": (7, "a"), "c": (11, "c")}
    assert sorted((r["indicator_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "full" / "observations")).collect()) == [(7, 1.0), (11, 1.0)]
    part = load.load(records, places, old, held, "slug", str(tmp_path / "part"))
    assert part == full | {"orphans": 0}
    assert sorted((r["indicator_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "part" / "observations")).collect()) == [(7, 1.0), (9, 6.0), (11, 1.0)]
    assert set(load.load(records.where("false"), places, old, held, "slug", str(tmp_path / "none")).values()) == {0} and not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="no districts"):
        load.load(records, places.where("false"), old, held, "slug", str(tmp_path / "none"))


def test_every_pair_with_few_and_many(spark, monkeypatch):
    from statloom import lineage

    left, right = spark.range(7).toDF("a"), spark.range(50).toDF("b")
    few = sorted(map(tuple, lineage.every_pair(left, right).collect()))
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 10)
    many = lineage.every_pair(left, right)
    assert sorted(map(tuple, many.collect())) == few == [(a, b) for a in range(7) for b in range(50)]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
