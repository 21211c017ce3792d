"""A thousand random sheets, read by grouping and windows, against a walk down each sheet."""

from __future__ import annotations

import random

from statloom.sources import grammar

PERIODS = {"2015 j.": (2015, "year", None), "2016": (2016, "year", None), "2017-jıl": (2017, "year", None), "2018-jıl yanvar-iyun": (2018, "ytd", 6), "2019M3": (2019, "month", 3), "2020 1-sherek": (2020, "quarter", 1)}
SPANS = {"Yanvar": 1, "Yanvar-fevral": 2, "Yanvar - mart": 3, "Yanvar-dekabr": 12, "Yanvar-iyun¹": 6}
YEARS = {k: v[0] for k, v in PERIODS.items() if len(k) <= 20}
PLACES = {"Nókis qalası": "nukus-shahri", "Nókis": "nukus-tumani", "Moynaq": "moynoq", "Qaraqalpaqstan Respublikası": None}
LABELS = ["Un", "Shay (mln. som)", "Jámi", "Qurılıs materialları", "eksport"]
MARKERS = ["sonnan:", "Shundan", "onnan"]
UNITS = ["mln. som", "ósiw páti, %", "Kartoshka", "mıń dana"]
HINTS = ("som", "%", "mıń", "dana", "mln")


def sheet(rng: random.Random) -> list[list]:
    wide = rng.randint(4, 9)
    grid = [[None] * wide for _ in range(rng.randint(9, 16))]
    low = rng.choice([1, 1, 2, 2, 3])
    label = 0 if low == 1 or rng.random() < 0.7 else 1
    head = rng.randint(1, 4)
    for row in range(head):
        if rng.random() < 0.6:
            grid[row][rng.randrange(wide)] = rng.choice(["Rayonlar boyınsha kólemi", "Tablica", "(mlrd. som)", "mln. som", "2014", "abc", "Islep shıǵarıw (mıń dana)", "2021-jıl"])
        if rng.random() < 0.4:
            for c in rng.sample(range(low, wide), min(2, wide - low)):
                grid[row][c] = rng.choice(["Jámi", "Taza", "Jámi"])
    spans = rng.random() < 0.4
    for c in range(low, wide):
        if rng.random() < 0.9:
            grid[head][c] = rng.choice(list(SPANS if spans else PERIODS))
    unit = low - 1 if low - label >= 2 else None
    for row in range(head + 1, len(grid)):
        kind = rng.random()
        if kind < 0.15:
            grid[row][label] = rng.choice(MARKERS)
            continue
        if kind < 0.85:
            grid[row][label] = rng.choice([*LABELS, *PLACES, *PLACES])
        if unit is not None and rng.random() < 0.6:
            grid[row][unit] = rng.choice(UNITS)
        if rng.random() < 0.9:
            for c in range(low, wide):
                if rng.random() < 0.85:
                    grid[row][c] = rng.choice(["1", "2,5", "-", "10", "3 000", "x"])
    return grid


def heading(grid: list[list], row: int) -> dict:
    direct = {c: PERIODS.get(v) or (YEARS[v], "year", None) if v in PERIODS else (int(v), "year", None) for c, v in enumerate(grid[row]) if v in PERIODS or v == "2014"}
    if "2021-jıl" in grid[row]:
        direct |= {c: (2021, "year", None) for c, v in enumerate(grid[row]) if v == "2021-jıl"}
    if len(direct) >= 3:
        return direct
    months = {c: SPANS[v] for c, v in enumerate(grid[row]) if v in SPANS}
    for above in range(row, -1, -1):
        years = [YEARS.get(v) or {"2014": 2014, "2021-jıl": 2021}[v] for v in grid[above] if v in YEARS or v in ("2014", "2021-jıl")]
        if years and len(months) >= 3:
            return {c: (years[0], "year", None) if m == 12 else (years[0], "ytd", m) for c, m in months.items()}
    return {}


def bracketed(texts: list[str]) -> str | None:
    for t in texts:
        inside = t[t.find("(") + 1 : t.find(")")] if "(" in t else ""
        if inside and any(h in inside for h in HINTS):
            return inside
    return None


def number(v) -> float | None:
    try:
        return float(v.replace(" ", "").replace(",", "."))
    except (AttributeError, ValueError):
        return None


def walked(grid: list[list]) -> list[tuple]:
    heads = [heading(grid, r) for r in range(min(10, len(grid)))]
    head = max(range(len(heads)), key=lambda r: (len(heads[r]), -r))
    periods = heads[head]
    if len(periods) < 3:
        return []
    texts = [v for line in grid[:head] for v in line if v and len(v) > 3]
    title = max(texts, key=len, default="")
    low = min(periods)
    label = next((c for c in range(low) if sum(bool(line[c]) for line in grid[head + 1 :]) >= 3), 0)
    unit = low - 1 if low - label >= 2 else None
    body = range(head + 1, len(grid))
    marked = [r for r in body if grid[r][label] in MARKERS]
    parent = {m: next((r for r in range(m - 1, head, -1) if grid[r][label] and r not in marked and any(grid[r][c] is not None for c in periods)), None) for m in marked}
    part = {}
    for i, m in enumerate(marked):
        later = marked[i + 1] if i + 1 < len(marked) else len(grid)
        until = later if parent.get(later) is None else parent[later]
        if parent[m] is not None:
            part |= {r: grid[parent[m]][label] for r in range(m + 1, until)}
        # a marker without a parent opens nothing, and what an earlier one opened has ended at it
    group: dict = {}
    if len(periods) >= 4:
        for r in range(head - 1, -1, -1):
            marks = {c: grid[r][c] for c in range(low, max(periods) + 1) if grid[r][c] and len(grid[r][c]) < 60}
            said, now = {}, ""
            for c in range(low, max(periods) + 1):
                now = marks.get(c, now)
                said[c] = now
            if 2 <= len(marks) <= len(periods) // 2 and len({said[c] for c in periods}) >= 2:
                group = said
                break
    out, seen, no, caption, other, last = [], set(), 0, "", "", ""
    for r in body:
        own, beside = grid[r][label], grid[r][unit] if unit is not None else None
        if own in MARKERS:
            continue
        last = own or last
        if not last:
            continue
        if last in PLACES:
            if last in seen:
                seen, no, caption = set(), no + 1, other
            seen.add(last)
            names = [title, caption]
        else:
            other = last
            names = [title, part.get(r), last, beside if beside != last else None]
        told = beside if beside and any(h in beside for h in HINTS) else None
        told = told or bracketed([last, *texts]) or next((t for t in texts if len(t) < 40 and any(h in t for h in ("mlrd", "mln", "mıń"))), "")
        for c, p in periods.items():
            if (v := number(grid[r][c])) is not None:
                name = " — ".join(x for x in [*names, group.get(c)] if x)
                out.append((name.strip(" —"), told, PLACES.get(last), *p, v, r, no))
    return out


def test_random_sheets_are_read_as_a_walk_reads_them(spark):
    rng = random.Random(17)
    grids = {f"f{i}#s": sheet(rng) for i in range(1800)}
    cells = [(s, "c", s, r, c, v) for s, grid in grids.items() for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None]
    found: dict = {}
    for r in grammar.records(spark.createDataFrame(cells, grammar.CELLS).repartition(4)).collect():
        found.setdefault(r["source"], []).append((r["indicator"], r["unit"], r["district_id"], r["year"], r["period"], r["period_no"], r["value"], r["row"], r["block"]))
    compared = wrong = 0
    for s, grid in grids.items():
        expected = walked(grid)
        if expected:  # other sheets may be read in another shape
            compared += 1
            if sorted(expected, key=repr) != sorted(found.get(s, []), key=repr):
                wrong += 1
                if wrong <= 2:
                    print(s, *grid, sep="\n")
                    print("missing", [x for x in expected if x not in found.get(s, [])][:5])
                    print("extra", [x for x in found.get(s, []) if x not in expected][:5])
    assert compared >= 1000 and wrong == 0
