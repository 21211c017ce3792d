"""Block-norm clustering against plain arithmetic: ties, junk vectors, repeats, few rows, wide components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from statloom.llm import block_norm_clustering as bn

VECTORS = "vec_id long, embedding array<double>, cluster string, norms string"


def plain(rows, count: int = bn.CENTROIDS, rounds: int = bn.ROUNDS) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= 2**19 for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in named[:count]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {}
    for _, k, d in found:
        total[k] = total.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, total[k], sum(total.values()), digest[k]) for i, k, d in found), key=repr)


def vectors(n: int, seed: int = 1, spread: float = 0.3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64)) * rng.uniform(0.1, 4, size=(12, 1))
    return [(i, (middles[i % 12] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


def found_of(spark, rows, **how) -> list[tuple]:
    df = spark.createDataFrame([(i, v, "own", "own") for i, v in rows], VECTORS)
    return sorted(map(tuple, bn.clustered(df, **how).collect()), key=repr)


def test_equals_plain_arithmetic_with_junk_repeats_and_ties(spark):
    rows = vectors(300)
    rows += [rows[7], rows[7], (None, rows[3][1]), (900, None), (901, [0.0] * 63), (902, [0.0] * 65), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [None] + [0.0] * 63), (906, []), (907, [0.0] * 64), (908, [0.0] * 64), (909, [1e300] * 64)]
    assert found_of(spark, rows) == plain(rows)


def test_equal_centroids_leave_the_larger_number_empty(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(20)]
    found = found_of(spark, rows, count=6)
    assert found == plain(rows, 6) and len({r[1] for r in found}) == 2


def test_few_vectors_none_and_wide_components(spark):
    rows = [(1, [2.0**19] * 64), (2, [-(2.0**19)] * 64), (3, [0.001] * 64)]
    assert found_of(spark, rows) == plain(rows)
    assert found_of(spark, rows, count=1, rounds=0) == plain(rows, 1, 0)
    assert found_of(spark, []) == []


def test_inertia_beyond_long_is_null(spark):
    rows = [(i, [2.0**19 * (1 if i % 2 else -1)] * 64) for i in range(40)]
    found = found_of(spark, rows, count=1, rounds=1)
    assert {r[4] for r in found} == {None} and min(r[2] for r in found) >= 0


@pytest.mark.parametrize("spread", [0.0, 0.05, 3.0])
def test_screening_leaves_out_only_what_cannot_be_nearest(spread):
    values = np.array([v for _, v in vectors(500, 4, spread)])
    points = np.floor(256 * values).astype(np.int64)
    centroids = points[:40]
    nearest, distance, exact = bn.assigned(points, bn.segment_norms(points), centroids)
    every = ((points[:, None] - centroids) ** 2).sum(axis=2)
    assert nearest.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
    assert len(points) <= exact <= points.shape[0] * 40
    if spread <= 0.05:  # norms that differ by class leave most centroids unmeasured
        assert exact < 0.5 * len(points) * 40
