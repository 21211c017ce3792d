"""Workbooks, sheets of each shape, files, uploads."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from statloom.sources import files, grammar
from statloom.streaming import uploads


def workbook(path, grid, sheet="S1"):
    """Writes a small .xlsx with numbers and inline strings."""

    def cell(r, c, v):
        name = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{name}"><v>{v}</v></c>'
        return f'<c r="{name}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    rows = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(grid))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def read(spark, tmp_path, grid):
    workbook(tmp_path / "02_Sanaat" / "w.xlsx", grid)
    (tmp_path / "02_Sanaat" / "broken.xlsx").write_bytes(b"\xd0\xcf\x11\xe0 not a zip")
    return grammar.records(grammar.read_cells(spark, str(tmp_path))).orderBy("ord").collect()


def test_periods_across_districts_down(spark, tmp_path):
    grid = [
        ["Rayonlar boyınsha sanaat ónimi kólemi"],
        ["(ámeldegi baxalarda, mlrd. som)"],
        [None, "2023 j.", "2024", 2025.0, "2026-jıl yanvar-iyun"],
        ["Qaraqalpaqstan Respublikası", 10, 11, 12, 6],
        ["Nókis qalası", 1, 2, 3, "-"],
        ["Nókis", 4, 5, "6,5", 1],
    ]
    rows = read(spark, tmp_path, grid)
    assert len(rows) == 11
    assert {r["category"] for r in rows} == {"02_Sanaat"} and {r["unit"] for r in rows} == {"ámeldegi baxalarda, mlrd. som"}
    assert {r["indicator"] for r in rows} == {"Rayonlar boyınsha sanaat ónimi kólemi"}
    assert [(r["year"], r["period"], r["period_no"], r["value"]) for r in rows if r["district_id"] is None] == [
        (2023, "year", None, 10.0), (2024, "year", None, 11.0), (2025, "year", None, 12.0), (2026, "ytd", 6, 6.0),
    ]
    assert [r["value"] for r in rows if r["district_id"] == "nukus-shahri"] == [1.0, 2.0, 3.0]
    assert [r["value"] for r in rows if r["district_id"] == "nukus-tumani"] == [4.0, 5.0, 6.5, 1.0]


def test_parts_and_units_beside(spark, tmp_path):
    grid = [
        ["Awıl xojalıǵı ónimleri kólemi"],
        ["Atı", "Birlik", "2020", "2021", "2022"],
        ["Ónim", "mlrd. som", 1, 2, 3],
        ["sonnan:", None, None, None, None],
        ["dıyqanshılıq", "mlrd. som", 4, 5, 6],
        [None, "% da", 7, 8, 9],
    ]
    rows = read(spark, tmp_path, grid)
    names = {(r["row"], r["indicator"], r["unit"]) for r in rows}
    title = "Awıl xojalıǵı ónimleri kólemi"
    assert names == {
        (2, f"{title} — Ónim — mlrd. som", "mlrd. som"), (4, f"{title} — Ónim — dıyqanshılıq — mlrd. som", "mlrd. som"), (5, f"{title} — Ónim — dıyqanshılıq — % da", "% da"),
    }


def test_stacked_blocks_and_groups(spark, tmp_path):
    grid = [
        ["Investitsiyalar kólemi"],
        [None, "A", None, "B", None],
        [None, "2020", "2021", "2020", "2021"],
        ["Beruniy", 1, 2, 3, 4],
        ["Xojeli", 5, 6, 7, 8],
        ["Banklar esabınan", None, None, None, None],
        ["Beruniy", 9, 10, 11, 12],
        ["Xojeli", 13, 14, 15, 16],
    ]
    rows = read(spark, tmp_path, grid)
    found = {(r["block"], r["indicator"]) for r in rows}
    assert found == {(b, f"Investitsiyalar kólemi{c} — {g}") for b, c in ((0, ""), (1, " — Banklar esabınan")) for g in "AB"}
    assert len(rows) == 16


def test_months_below_a_year(spark, tmp_path):
    grid = [["Sawda kólemi, mln. som"], [None, "2026-jıl"], [None, "Yanvar", "Yanvar-fevral", "Yanvar-dekabr"], ["Beruniy", 1, 2, 12], ["Xojeli", 1, 2, 3], ["Kegeyli", 1, 2, 3]]
    rows = read(spark, tmp_path, grid)
    assert [(r["year"], r["period"], r["period_no"]) for r in rows[:3]] == [(2026, "ytd", 1), (2026, "ytd", 2), (2026, "year", None)]


def test_periods_down(spark, tmp_path):
    grid = [["Tuwılǵanlar sanı (adam)"], [None, "Jámi", None], [None, "erkek", "hayal"], ["2020", 10, 20], ["Beruniy", 1, 2], ["*) esletpe", 5, 5], ["2021", 11, 21], ["2022", 12, 22]]
    rows = read(spark, tmp_path, grid)
    assert {r["indicator"] for r in rows} == {f"Tuwılǵanlar sanı (adam) — Tuwılǵanlar sanı (adam) — Jámi — {x}" for x in ("erkek", "hayal")}
    assert [(r["district_id"], r["year"], r["value"]) for r in rows if r["indicator"].endswith("hayal")] == [(None, 2020, 20.0), ("beruniy", 2020, 2.0), (None, 2021, 21.0), (None, 2022, 22.0)]


def test_districts_across(spark, tmp_path):
    grid = [["2026-jıl yanvar-iyun kórsetkishleri, mln. som"], [None, "Beruniy", "Xojeli", "Kegeyli", "Shımbay", "Moynaq"], ["Kirim", 1, 2, 3, 4, 5], ["Shıǵım", 6, 7, 8, 9, 10]]
    rows = read(spark, tmp_path, grid)
    assert len(rows) == 10
    assert {(r["year"], r["period"], r["period_no"]) for r in rows} == {(2026, "ytd", 6)}
    assert [r["value"] for r in rows if r["district_id"] == "moynoq"] == [5.0, 10.0]


def test_bulk_plans(spark, tmp_path):
    (tmp_path / "p.csv").write_text("module,region,year,kpi_planned,kpi_actual,status\nm,r,2024,10,\"9,5\",\n,r,2024,1,1,x\nm,r,abc,1,1,x\n")
    good, bad = files.bulk_plans(spark, str(tmp_path / "p.csv"))
    assert [(r["year"], r["kpi_actual"], r["status"]) for r in good.collect()] == [(2024, 9.5, "in_progress")]
    assert sorted(r["error"] for r in bad.collect()) == ["module is empty", "year: abc"]


def test_uploads_replace_indicators(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, uploads.OBSERVATIONS)
    rows((1, "a", 2020, "year", None, 1.0, 1), (2, "a", 2020, "year", None, 2.0, 2)).write.parquet(str(tmp_path / "in" / "b1"))
    files_ = str(tmp_path / "in" / "*")
    run = lambda: uploads.upsert_stream(uploads.incoming(spark, files_), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    rows((2, "a", 2020, "year", None, 5.0, 1), (2, "a", 2020, "year", None, 6.0, 2)).write.parquet(str(tmp_path / "in" / "b2"))
    run()
    found = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r["indicator_id"], r["value"]) for r in found) == [(1, 1.0), (2, 5.0)]


def test_workbook_source(spark, tmp_path):
    from pyspark.sql import functions as F

    from statloom.constants import DUPLICATES_FOLDER
    from statloom.sources import workbook as books
    from statloom.sources import workbook_source

    workbook(tmp_path / "02_Sanaat" / "Wages 1.xlsx", [["a", 1.5, None], [None, "b", 1]])
    (tmp_path / "02_Sanaat" / "old.xlsx").write_bytes(b"\xd0\xcf\x11\xe0 not a zip")
    whole = books.packed([("one", {(0, 0): "x"}), ("two", {(1, 27): 2.0})])
    (tmp_path / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "torn.xlsx").write_bytes(whole.replace(b"sheet1.xml", b"sheet7.xml"))
    (tmp_path / "~$lock.xlsx").write_bytes(b"")
    (tmp_path / DUPLICATES_FOLDER).mkdir()
    (tmp_path / DUPLICATES_FOLDER / "d.xlsx").write_bytes(whole)
    (tmp_path / "note.txt").write_text("no")
    cells, bad = workbook_source.read_workbooks(spark, str(tmp_path))
    assert sorted((r["source"], r["row"], r["col"], r["text"]) for r in cells.collect()) == [("Wages 1.xlsx#S1", 0, 0, "a"), ("Wages 1.xlsx#S1", 0, 1, "1.5"), ("Wages 1.xlsx#S1", 1, 1, "b"), ("Wages 1.xlsx#S1", 1, 2, "1.0"), ("torn.xlsx#two", 1, 27, "2.0")]
    told = {r["source"]: r["bad"] for r in bad.collect()}
    assert set(told) == {"old.xlsx", "cut.xlsx", "torn.xlsx#one"} and all(told.values())
    assert cells.columns == [c.split()[0] for c in grammar.CELLS.split(", ")]
    assert {r["category"] for r in cells.where("source like 'Wages%'").collect()} == {"02_Sanaat"}
    only, none = workbook_source.read_workbooks(spark, str(tmp_path), keyword="wages", category="own")
    assert {(r["source"], r["category"]) for r in only.collect()} == {("Wages 1.xlsx#S1", "own")} and none.count() == 0
    every, _ = workbook_source.read_workbooks(spark, str(tmp_path), skip="")
    assert every.where(F.col("source").startswith("d.xlsx")).count() == 2
    one, _ = workbook_source.read_workbooks(spark, str(tmp_path / "torn.xlsx"))
    assert one.count() == 1
    (tmp_path / "empty").mkdir()
    nothing, no = workbook_source.read_workbooks(spark, str(tmp_path / "empty"))
    assert nothing.count() == no.count() == 0
    assert spark.read.format("workbook").load(str(tmp_path)).rdd.getNumPartitions() == 4


def test_workbooks_are_read_as_sheets(spark, tmp_path):
    from statloom.sources import workbook_source

    grid = [["Rayonlar boyınsha sanaat ónimi kólemi (mlrd. som)"], [None, "2023 j.", "2024", "2025"], ["Nókis qalası", 1, 2, 3], ["Nókis", 4, 5, 6]]
    workbook(tmp_path / "02_Sanaat" / "w.xlsx", grid)
    cells, _ = workbook_source.read_workbooks(spark, str(tmp_path))
    assert sorted((r["district_id"], r["year"], r["value"]) for r in grammar.records(cells).collect()) == sorted((r["district_id"], r["year"], r["value"]) for r in grammar.records(grammar.read_cells(spark, str(tmp_path))).collect())


def test_bulk_workbooks_name_what_they_cannot_load(spark, tmp_path):
    workbook(tmp_path / "good.xlsx", [["module", "region", "year", "kpi_actual"], ["m", "r", 2024, 1.5], ["m", None, 2024, "x"]])
    workbook(tmp_path / "lacks.xlsx", [["module", "year"], ["m", 2024]])
    (tmp_path / "none.xlsx").write_bytes(b"no")
    good, wrong = files.bulk_workbooks(spark, str(tmp_path))
    assert [(r["module"], r["region"], r["year"], r["kpi_actual"]) for r in good.collect()] == [("m", "r", 2024, 1.5)]
    assert sorted(r["error"] for r in wrong.collect()) == ["lacks.xlsx: missing columns: region", "none.xlsx: no workbook", "region is empty; kpi_actual: x"]
