"""Boosted trees against a plain booster, and what they are for."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import boosting

NAMES = ["a", "b", "c"]
UNIT = 1 << 32


def table(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.uniform(0, 5)
        label = 2 if a + 0.3 * c > 1.2 else 1 if b > 1 and c < 3 else 0
        rows.append((a if rng.random() > 0.1 else None, b, c if rng.random() > 0.05 else float("nan"), label))
    return rows + rows[:5] + [(0.1, None, None, None)]


def plain_bins(rows: list[tuple], edges: list[list[float]]) -> list[list[int]]:
    return [[0 if x is None or math.isnan(x) else 1 + sum(e < x for e in own) for x, own in zip(r[:3], edges, strict=True)] for r in rows]


def plain_trees(rows, edges, rounds: int, depth: int, rate: float, lam: float = 1.0, least: float = 1.0):
    """For each round and class a nested tuple: (value) or (feature, cut, missing left, left, right)."""
    rows = [r for r in rows if r[3] is not None]
    bins = plain_bins(rows, edges)
    margins = [[0.0] * 3 for _ in rows]
    out = []
    for _ in range(rounds):
        grads = []
        for m, r in zip(margins, rows, strict=True):
            e = [math.exp(x - max(m)) for x in m]
            p = [x / sum(e) for x in e]
            grads.append([(round((p[k] - (r[3] == k)) * UNIT), round(2 * p[k] * (1 - p[k]) * UNIT)) for k in range(3)])
        trees = []
        for k in range(3):

            def grow(own, left_levels, k=k):
                g, h = (sum(grads[i][k][j] for i in own) / UNIT for j in (0, 1))
                best = None
                if left_levels:
                    for f in range(3):
                        for to_left in (True, False):
                            for cut in range(1, max(len(e) for e in edges) + 1):
                                left = [i for i in own if (to_left if bins[i][f] == 0 else bins[i][f] <= cut)]
                                a, b = (sum(grads[i][k][j] for i in left) / UNIT for j in (0, 1))
                                if b < least or h - b < least:
                                    continue
                                gain = a * a / (b + lam) + (g - a) ** 2 / (h - b + lam) - g * g / (h + lam)
                                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                    best = (gain, f, cut, to_left, left)
                if best is None:
                    return (-rate * g / (h + lam),)
                rest = sorted(set(own) - set(best[4]))
                return (*best[1:4], grow(best[4], left_levels - 1), grow(rest, left_levels - 1))

            trees.append(grow(list(range(len(rows))), depth))
        out.append(trees)
        for i, m in enumerate(margins):
            for k, tree in enumerate(trees):
                while len(tree) > 1:
                    b = bins[i][tree[0]]
                    tree = tree[3] if (tree[2] if b == 0 else b <= tree[1]) else tree[4]
                m[k] += tree[0]
    return out


def nested(tree: boosting.Tree, node: int = 0):
    if tree.feature[node] < 0:
        return (tree.value[node],)
    return (tree.feature[node], tree.cut[node], tree.missing_left[node], nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1))


def flat(tree) -> list:
    return [tree[0]] if len(tree) == 1 else [*tree[:3], *flat(tree[3]), *flat(tree[4])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(150), "a double, b double, c double, label int").repartition(3).cache()


def test_the_trees_are_those_of_a_plain_booster(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    model = boosting.fit(rows, NAMES, rounds=5, depth=3, rate=0.3, subsample=1.0, colsample=1.0, bins=8)
    expected = plain_trees(table(150), model.edges, 5, 3, 0.3)
    for mine, theirs in zip(model.rounds, expected, strict=True):
        for tree, other in zip(mine, theirs, strict=True):
            assert flat(nested(tree)) == pytest.approx(flat(other), abs=1e-9)


def test_how_rows_are_dealt_does_not_matter(rows):
    one = boosting.fit(rows, NAMES, rounds=3, depth=3, bins=8)
    other = boosting.fit(rows.repartition(7, "b").orderBy("c"), NAMES, rounds=3, depth=3, bins=8)
    assert one == other


def test_sampling_takes_its_share_and_differs_by_round():
    ids = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    first, second = (boosting._sampled(ids, r, 0.8) for r in (0, 1))
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & second).mean() - 0.64) < 0.015


def test_scores_and_importances(spark, rows, tmp_path):
    model = boosting.fit(rows, NAMES, rounds=15, depth=3, rate=0.3, bins=16)
    found = boosting.scored(model, rows.withColumn("p0", F.lit("own")), ["a", "label"])
    assert found.columns == ["a", "label", "predicted", "p0", "p1", "p2"]
    held = found.where("label is not null").collect()
    assert sum(r["predicted"] == r["label"] for r in held) / len(held) > 0.93
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 for r in held)
    shares = model.importances()
    assert {n for n, _ in shares} == set(NAMES) and abs(sum(s for _, s in shares) - 1) < 1e-9
    model.save(spark, str(tmp_path / "model"))
    assert boosting.Boosted.load(spark, str(tmp_path / "model")) == model


def test_tables_without_rows_labels_or_values(spark):
    kinds = "a double, b double, c double, label int"
    none = spark.createDataFrame([], kinds)
    model = boosting.fit(none, NAMES, rounds=2)
    assert boosting.scored(model, none, ["label"]).count() == 0
    unlabelled = spark.createDataFrame([(1.0, None, float("nan"), None)] * 3, kinds)
    model = boosting.fit(unlabelled, NAMES, rounds=2)
    assert [r["predicted"] for r in boosting.scored(model, unlabelled, ["label"]).collect()] == [0, 0, 0]
    same = boosting.fit(spark.createDataFrame([(1.0, 1.0, 1.0, 1)] * 4, kinds), NAMES, rounds=3, subsample=1.0)
    assert [r["predicted"] for r in boosting.scored(same, unlabelled, ["label"]).collect()] == [1, 1, 1]
