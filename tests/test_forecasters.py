"""Changepoint and recurrent forecasters: optimality, recovery, coverage, gradients, what a lag cannot learn."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from statloom.operators import backtest, changepoints, recurrent
from statloom.plans import catalogue, more, tables  # noqa: F401

SERIES = "k string, year int, v double"


def test_coefficients_are_the_most_probable():
    """Where a change is not zero the slope of the loss is that of the prior; where it is zero it is at most that."""
    rng = np.random.default_rng(2)
    at = np.arange(2000.0, 2024)
    y = 50 + 3 * (at - 2000) + 6 * np.maximum(at - 2012, 0) + rng.normal(0, 1.5, len(at))
    fit = changepoints.fitted(at, y, turns=200)
    t, z = (at - fit.start) / fit.span, y / fit.scale
    ramps = np.c_[np.ones(len(t)), t, np.maximum(t[:, None] - fit.points, 0)]
    pull = ramps.T @ (z - ramps @ fit.trend) / fit.sigma**2
    assert pull[:2] == pytest.approx(fit.trend[:2] / 25, abs=1e-4)
    moved = np.abs(fit.trend[2:]) > 1e-5
    assert 1 <= moved.sum() < len(fit.points)
    assert pull[2:][moved] == pytest.approx(np.sign(fit.trend[2:][moved]) / changepoints.PRIOR, rel=1e-3)
    assert (np.abs(pull[2:][~moved]) <= (1 + 1e-3) / changepoints.PRIOR).all()
    assert 0.5 < fit.sigma * fit.scale / 1.5 < 1.5


def test_a_broken_trend_is_recovered(spark):
    rows = [("break", y, 100.0 + 2 * (y - 1990) + (18 * (y - 2005) if y > 2005 else 0)) for y in range(1990, 2021)]
    rows += [("few", 2000, 1.0), ("few", 2001, 2.0), ("gap", 2000, None), ("flat", 1999, 5.0), ("flat", 2000, 5.0), ("flat", 2001, 5.0), ("flat", 2001, 5.0)]
    df = spark.createDataFrame(rows, SERIES)
    found = {(r["k"], r["year"]): r for r in changepoints.yearly_forecast(df, "k", "v", 3).collect()}
    assert {k for k, _ in found} == {"break", "flat"}
    for year in (2021, 2022, 2023):
        truth = 100 + 2 * (year - 1990) + 18 * (year - 2005)
        r = found["break", year]
        assert r["yhat"] == pytest.approx(truth, rel=0.02) and r["lower"] <= r["yhat"] <= r["upper"]
        assert found["flat", year - 19]["yhat"] == pytest.approx(5, rel=0.02)
    trend = {r["year"]: r for r in changepoints.yearly_trend(df.where("k = 'break'"), "k", "v", 2).collect()}
    assert len(trend) == 33 and not trend[2020]["future"] and trend[2022]["future"]
    slopes = [trend[y + 1]["trend"] - trend[y]["trend"] for y in (1995, 2015)]
    assert slopes == pytest.approx([2, 20], rel=0.1)


def test_bounds_cover_what_comes(spark):
    """Futures simulated as the model supposes: 90 percent bounds hold 80 to 97 percent of them."""
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for k, (often, size, noise, years) in enumerate([(0.25, 0.5, 1.5, 26), (0.25, 0.5, 4.0, 26), (0.25, 2.0, 1.5, 26), (0.05, 0.5, 1.5, 26), (0.25, 0.5, 1.5, 14)] * 20):
        slope, level, path = 1.0, 100.0, []
        for _ in range(years + 4):
            slope += rng.laplace(0, size) if rng.uniform() < often else 0
            level += slope
            path.append(level + rng.normal(0, noise))
        rows += [(f"s{k}", 1990 + i, float(v)) for i, v in enumerate(path[:years])]
        truth |= {(f"s{k}", 1990 + i): path[i] for i in range(years, years + 4)}
    found = changepoints.yearly_forecast(spark.createDataFrame(rows, SERIES), "k", "v", 4).collect()
    inside = [r["lower"] <= truth[r["k"], r["year"]] <= r["upper"] for r in found]
    assert len(inside) == 400 and 0.80 <= np.mean(inside) <= 0.97


def test_quarters_have_a_season(spark):
    share = {1: 0.8, 2: 1.0, 3: 1.05, 4: 1.15}
    rows = [("w", y, q, (100 + 8 * (y + q / 4 - 2015)) * share[q]) for y in range(2015, 2024) for q in range(1, 5)]
    found = changepoints.quarterly_forecast(spark.createDataFrame(rows, "k string, year int, quarter int, v double"), "k", "v").collect()
    assert [(r["year"], r["quarter"]) for r in sorted(found, key=lambda r: (r["year"], r["quarter"]))] == [(y, q) for y in (2024, 2025, 2026) for q in range(1, 5)]
    for r in found:
        assert r["yhat"] == pytest.approx((100 + 8 * (r["year"] + r["quarter"] / 4 - 2015)) * share[r["quarter"]], rel=0.03) and r["lower"] < r["upper"]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    cell, x, y = recurrent.Cell(2, 5, 1), rng.normal(size=(7, 4, 2)), rng.normal(size=7)
    keep = (rng.uniform(size=(7, 5)) >= 0.3) / 0.7
    loss = lambda: 0.5 * ((cell.forward(x, keep)[0] - y) ** 2).sum()
    out, past = cell.forward(x, keep)
    grad = cell.backward(past, out - y, keep)
    for name, g in grad.items():
        for at in np.ndindex(*g.shape):
            held = cell.w[name][at]
            cell.w[name][at] = held + 1e-6
            above = loss()
            cell.w[name][at] = held - 1e-6
            assert (above - loss()) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-6)
            cell.w[name][at] = held


def test_a_period_of_three_is_learnt(spark):
    """After 10 comes 20, after 10 comes 40: one lag cannot tell which; a window can."""
    values = [(10.0, 10.0, 40.0)[i % 3] for i in range(36)]
    rows = [("p", 1980 + i, v) for i, v in enumerate(values)] + [("few", 2000 + i, 1.0 * i) for i in range(6)]
    df = spark.createDataFrame(rows, SERIES)
    found = sorted(recurrent.forecast(df, "k", "v", 6).collect(), key=lambda r: r["year"])
    assert [r["k"] for r in found] == ["p"] * 6 and [r["year"] for r in found] == list(range(2016, 2022))
    truth = [(10.0, 10.0, 40.0)[i % 3] for i in range(36, 42)]
    assert [r["yhat"] for r in found] == pytest.approx(truth, rel=0.25)
    assert all(r["lower"] < r["upper"] for r in found)
    again = sorted(recurrent.forecast(df.repartition(5), "k", "v", 6).collect(), key=lambda r: r["year"])
    assert [r["yhat"] for r in again] == [r["yhat"] for r in found]


def test_inputs_of_years_ahead_are_used(spark):
    rows = [("a", 1990 + i, 100.0 + 50 * np.sin(i) if i < 30 else None, 100.0 + 50 * np.sin(i + 1)) for i in range(33)]
    df = spark.createDataFrame([(k, y, None if v is None else float(v), float(x)) for k, y, v, x in rows], "k string, year int, v double, x double")
    found = sorted(recurrent.forecast(df, "k", "v", 3, ("x",)).collect(), key=lambda r: r["year"])
    truth = [100 + 50 * np.sin(i) for i in (30, 31, 32)]
    assert [r["year"] for r in found] == [2020, 2021, 2022]
    assert np.abs(np.array([r["yhat"] for r in found]) - truth).mean() < 20
    beyond = recurrent.forecast(df.where("v is not null"), "k", "v", 3, ("x",)).collect()
    assert len(beyond) == 3


SF = "/root/testdata/sf0.001"


def series_of(rows) -> dict:
    out: dict = {}
    for r in rows.orderBy("year").collect():
        out.setdefault(r["district_id"], []).append((r["year"], float(r["active"])))
    return {k: (np.array([y for y, _ in v], float), np.array([x for _, x in v])) for k, v in out.items()}


def test_changepoint_query_gives_the_figures_of_single_fits(spark):
    found = {(r["district_id"], r["year"]): r for r in catalogue.QUERIES["changepoint_forecasts"](spark, SF).collect()}
    for key, (years, values) in series_of(tables.panel(spark, SF)).items():
        ahead = years[-1] + np.arange(1, 6)
        assert len(years) >= 3 or not any(k == key for k, _ in found)
        if len(years) >= 3:
            fit = changepoints.fitted(years, values)
            assert [found[key, int(y)]["yhat"] for y in ahead] == pytest.approx((fit.parts(ahead)[0] * fit.scale).tolist())
            assert all(found[key, int(y)]["lower"] < found[key, int(y)]["upper"] for y in ahead)


def test_recurrent_query_and_grid_give_the_figures_of_single_fits(spark):
    learnt = {(r["district_id"], r["year"]): r["yhat"] for r in catalogue.QUERIES["recurrent_forecasts"](spark, SF).collect()}
    grid = {(r["district_id"], r["configuration"]): r["mape"] for r in catalogue.QUERIES["backtest_grid"](spark, SF).collect()}
    compared = 0
    for key, (years, values) in sorted(series_of(tables.quarters(spark, SF)).items())[:4]:
        ahead = years[-1] + np.arange(1, 6)
        if len(years) >= 7:
            single = recurrent.predicted(values[:, None], np.empty((5, 0)), 3, 16, 0.2, recurrent.EPOCHS, 200, 7 + zlib.crc32(key.encode()))
            assert [learnt[key, int(y)] for y in ahead] == pytest.approx(single[0].tolist())
        errors = []
        for origin in (1998 * 4, 1999 * 4):
            past, test = years <= origin, (years > origin) & (years <= origin + 2)
            if past.sum() >= 3 and test.any():
                fit = changepoints.fitted(years[past], values[past])
                errors += np.abs(fit.parts(years[test])[0] * fit.scale / values[test] - 1).tolist()
        if errors:
            assert grid[key, "changepoints"] == pytest.approx(float(np.mean(errors) * 100))
            compared += 1
    assert compared and {c for _, c in grid} == {c.name for c in (*backtest.CLOSED, *backtest.GRID)} | {"changepoints"}


def test_dispatcher_gives_the_figures_of_its_models(spark):
    rows = catalogue.QUERIES["forecast_figures"](spark, SF).collect()
    assert {(r["indicator"], r["model"]) for r in rows} == {("export", "recurrent"), ("investment", "recurrent"), ("services", "ensemble"), ("macro", "changepoints"), ("other", "changepoints")}
    orders: dict = {}
    for r in tables.quarters(spark, SF).collect():
        orders[r["year"]] = orders.get(r["year"], 0) + r["active"]
    fit = changepoints.fitted(np.array(sorted(orders), float), np.array([2.0 * orders[y] for y in sorted(orders)]))
    for r in rows:
        assert r["lower"] <= r["upper"]
        if r["indicator"] == "macro":
            assert r["yhat"] == pytest.approx(float(fit.parts(np.array([float(r["year"])]))[0][0] * fit.scale))


def test_errors_that_are_equal_tie_by_name_and_short_series_are_left_out(spark):
    rows = [("two", 2000, 1.0), ("two", 2001, 2.0), ("two", 2002, 4.0), ("one", 2001, 1.0), ("one", 2002, 1.0), ("gap", 2000, 1.0), ("gap", 2001, None)]
    df = spark.createDataFrame(rows, SERIES)
    found = {r["k"]: r for r in backtest.chosen(df, "k", "v", origins=(2001,)).collect()}
    assert list(found) == ["two"] and found["two"]["configuration"] == "drift" and found["two"]["mape"] == 25


def test_quarterly_query_gives_the_figures_of_single_fits(spark):
    series: dict = {}
    for r in tables.read(spark, SF, "orders").selectExpr("o_orderpriority k", "year(o_orderdate) + (quarter(o_orderdate) - 0.5) / 4 at").groupBy("k", "at").count().orderBy("at").collect():
        series.setdefault(r["k"], []).append((float(r["at"]), float(r["count"])))
    found = {(r["o_orderpriority"], r["year"] + (r["quarter"] - 0.5) / 4): r for r in catalogue.QUERIES["quarterly_forecasts"](spark, SF).collect()}
    assert len(found) == 12 * len(series)
    for key, rows in series.items():
        at, y = (np.array(x) for x in zip(*rows, strict=True))
        fit = changepoints.fitted(at, y, 2)
        ahead = at[-1] + 0.25 * np.arange(1, 13)
        trend, season = fit.parts(ahead)
        assert [found[key, float(a)]["yhat"] for a in ahead] == pytest.approx((fit.scale * trend * season).tolist())


def test_weak_spots_are_those_of_the_rule(spark):
    rows = catalogue.QUERIES["weak_spot_list"](spark, SF).collect()
    assert [(-r["p2"], r["district_id"]) for r in rows] == sorted((-r["p2"], r["district_id"]) for r in rows) and len({r["year"] for r in rows}) <= 1
    assert sum(r["label"] == 2 for r in rows) >= 0.8 * len(rows)
    shares = catalogue.QUERIES["feature_shares"](spark, SF).collect()
    assert len(shares) == 5 and shares[0]["feature"] in ("rate", "employed_share", "unemployed_share") and [r["share"] for r in shares] == sorted((r["share"] for r in shares), reverse=True)
