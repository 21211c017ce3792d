"""Polygons of (shape_id, ring), ring an array of points (x, y), as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points times edges that are held at once.
TOGETHER = 1 << 18


def path_points(path: Column) -> Column:
    """The points of an absolute path of M, L, H, V and Z commands."""
    tokens = F.regexp_extract_all(F.upper(path), F.lit(r"([MLHV]\s*-?[\d.]+(?:[\s,]+-?[\d.]+)?)"), 1)
    none = F.array().cast("array<struct<x:double,y:double>>")

    def step(points: Column, token: Column) -> Column:
        kind = F.substring(token, 1, 1)
        numbers = F.transform(F.regexp_extract_all(token, F.lit(r"(-?[\d.]+)"), 1), lambda n: n.cast("double"))
        last = F.try_element_at(points, F.lit(-1))
        x = F.when(kind == "V", last["x"]).otherwise(F.get(numbers, F.lit(0)))
        y = F.when(kind == "H", last["y"]).when(kind == "V", F.get(numbers, F.lit(0))).otherwise(F.get(numbers, F.lit(1)))
        return F.concat(points, F.array(F.struct(x.alias("x"), y.alias("y"))))

    return F.aggregate(tokens, none, step)


def signed_area(ring: Column) -> Column:
    """Half the sum of cross products of neighbours, the ring closed."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, x: a + x) / 2


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the parity of crossings to its right."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(
        ring, following,
        lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]),
    )
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def distance_to_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def bounding_boxes(shapes: DataFrame, *keys: str, pad: float = 0.0) -> DataFrame:
    """The least box around all rings of each key."""
    rows = shapes.select(*keys, F.explode("ring").alias("p"))
    return rows.groupBy(*keys).agg(
        (F.min("p.x") - pad).alias("x0"), (F.min("p.y") - pad).alias("y0"), (F.max("p.x") + pad).alias("x1"), (F.max("p.y") + pad).alias("y1")
    )


def main_ring(shapes: DataFrame, key: str) -> DataFrame:
    """The ring of the largest absolute area of each key."""
    return shapes.groupBy(key).agg(F.max_by("ring", F.abs(signed_area(F.col("ring")))).alias("ring"))


def label_points(shapes: DataFrame, key: str, steps: int = 49) -> DataFrame:
    """The point of a grid over each ring's box that lies inside and farthest from the edge; rings without such a point give none.

    Ties go to the lowest row of the grid, then to its leftmost point.
    """
    rows = shapes.where(F.size("ring") > 0).join(bounding_boxes(shapes, key), key)
    part = lambda name: F.transform("ring", lambda p: p[name].cast("double")).alias(name)
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
            first = np.r_[0, np.cumsum(batch.column("x").value_lengths().to_numpy())]
            xs, ys = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "xy")
            away, at = np.full(len(x0), -np.inf), np.zeros(len(x0), np.int64)
            for some in _of_a_size(np.diff(first)):
                edges = _edges(xs, ys, first[some], np.diff(first)[some])
                away[some], at[some] = _deepest(edges, x0[some], y0[some], x1[some], y1[some], steps)
            found = np.flatnonzero(away > -np.inf)
            x, y = (_grid(a[found], b[found], i[found], steps) for a, b, i in ((x0, x1, at % steps), (y0, y1, at // steps)))
            columns = [batch.column(0).take(pa.array(found)), *map(pa.array, (x, y, away[found]))]
            yield pa.record_batch(columns, names=["key", "x", "y", "away"])

    kind = shapes.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), part("x"), part("y"), *box).mapInArrow(place, f"key {kind}, x double, y double, away double")
    return found.withColumnRenamed("key", key)


def _grid(low: np.ndarray, high: np.ndarray, i: np.ndarray, steps: int) -> np.ndarray:
    return low + (high - low) * (i + 0.5) / steps


def _of_a_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows whose rings have about as many points, so many that a step's arrays stay small."""
    order = np.argsort(sizes, kind="stable")
    ends = np.searchsorted(sizes[order], 2 ** np.arange(int(sizes.max(initial=0)).bit_length() + 1))
    for a, b in zip(ends, ends[1:], strict=False):
        step = max(TOGETHER // max(int(sizes[order[b - 1]]), 49), 1) if b > a else 1
        yield from (order[i : min(i + step, b)] for i in range(a, b, step))


def _edges(xs: np.ndarray, ys: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """x, y, dx and dy of the edges of some rings; shorter rings stay at their last point, which neither crosses nor comes nearer."""
    i = np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)
    following = np.where(np.arange(sizes.max()) < sizes[:, None] - 1, i + 1, np.where(i == np.arange(sizes.max()), 0, i))
    here, there = first[:, None] + i, first[:, None] + following
    return np.stack([xs[here], ys[here], xs[there] - xs[here], ys[there] - ys[here]])


def _met(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points (ring, point) lie inside, and their least distance to an edge."""
    inside, least = np.zeros(x.shape, bool), np.full(x.shape, np.inf)
    step = max(TOGETHER // max(x.size, 1), 1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for i in range(0, edges.shape[2], step):
            ax, ay, dx, dy = (e[:, None, :] for e in edges[:, :, i : i + step])
            u, v, length = x[:, :, None] - ax, y[:, :, None] - ay, dx * dx + dy * dy
            crosses = ((v < 0) != (v - dy < 0)) & (u < dx * v / dy)
            t = np.where(length == 0, 0.0, np.clip((u * dx + v * dy) / length, 0.0, 1.0))
            away = (u - t * dx) ** 2 + (v - t * dy) ** 2
            inside ^= np.logical_xor.reduce(crosses, axis=2)
            least = np.fmin(least, np.fmin.reduce(away, axis=2))  # an edge without coordinates comes near no point
    return inside, np.sqrt(least)


def _deepest(edges: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of each ring's deepest grid point; -inf where none lies inside.

    The middle points of square blocks of the grid are met first. No point is farther from the
    edges than the middle of its block by more than it lies away from it, so only blocks that
    may hold a point as deep as the deepest middle are walked: the result is that of the whole grid.
    """
    side = max(round(steps**0.5), 1)
    middle = np.minimum(np.arange(0, steps, side) + side // 2, steps - 1)
    place = lambda of, i, j: (_grid(x0[of, None], x1[of, None], i, steps), _grid(y0[of, None], y1[of, None], j, steps))
    every = np.arange(len(x0))
    inside, least = _met(edges, *place(every, np.tile(middle, len(middle))[None], np.repeat(middle, len(middle))[None]))
    reach = side // 2 * np.hypot(x1 - x0, y1 - y0) / steps
    blur = 1e-9 * (np.abs(x0) + np.abs(x1) + np.abs(y0) + np.abs(y1))  # more than rounding can differ
    ring, block = np.nonzero(~(least + (reach + blur)[:, None] < np.where(inside, least, -np.inf).max(axis=1)[:, None]))
    away, at = np.full(len(x0), -np.inf), np.zeros(len(x0), np.int64)
    within = np.arange(side * side)
    step = max(TOGETHER // max(side * side, edges.shape[2]), 1)
    for a in range(0, len(ring), step):
        of, b = ring[a : a + step], block[a : a + step, None]
        i, j = b % len(middle) * side + within % side, b // len(middle) * side + within // side
        inside, least = _met(edges[:, of], *place(of, i, j))
        depth = np.where(inside & (i < steps) & (j < steps), least, -np.inf)
        number, best = j * steps + i, depth.max(axis=1)
        number = np.where(depth == best[:, None], number, steps * steps).min(axis=1)
        of, best, number = np.r_[every, of], np.r_[away, best], np.r_[at, number]
        order = np.lexsort((number, -best, of))
        order = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        away, at = best[order], number[order]
    return away, at
