"""Nearest neighbours by collision counting over single projections.

Vectors are dealt by a hash to shards of bounded size.  A shard keeps, for each of
``PROJECTIONS`` random directions, its vectors sorted by their projection.  A query opens a
window around its own projection in each sorted array and widens all windows by virtual
rehashing: only the newly covered stretches are counted.  Vectors that have collided in at
least ``SHARE`` of the projections are verified by their exact cosine.  The search of a shard
ends when the k-th best vector found, or the bound that the query brings along, lies within the
current radius; the last radius covers the whole arrays, so a query without a bound finds k
vectors in a shard that has them.

Queries first search one shard each, which gives every query its bound; with it they search
the others.  Every vector is indexed.  A task holds one shard and a bounded slice of the queries.

Defined results: vectors that are null, zero, hold a null or a number that isn't finite, or
have another length than most take no part, nor do rows whose vec_id is null or no whole number;
rows of equal vec_id count once, with the least vector; ties go to the smaller vec_id; other
columns play no part, whatever their names; no vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stage

PROJECTIONS = 128
#: Bytes of vectors in a shard, and of queries that a task meets it with.
SHARD_BYTES = 32 << 20
SLICE_BYTES = 32 << 20
#: Half a window, in projected lengths, for a radius of 1, and the share of collisions asked for.
WIDTH = 1.0
SHARE = 0.64
RADII = (0.2, 0.4, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.35, 1.4)


def directions(length: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(PROJECTIONS, length))


class Shard:
    """The sorted arrays of some vectors, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        projected = (self.vectors / self.norms[:, None]) @ directions(vectors.shape[1]).T
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.sorted = np.take_along_axis(projected.T, self.order.astype(np.int64), 1)
        self.counted = self.verified = 0  # entries of the arrays, and vectors, over all searches

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """For each query, radius and projection the stretch of the sorted array within the window: [low, high)."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / norms[:, None]) @ directions(queries.shape[1]).T
        half = WIDTH * np.array([0.0, *RADII])
        out = np.empty((len(queries), len(RADII) + 2, PROJECTIONS, 2), np.int32)
        for i, line in enumerate(self.sorted):
            out[:, :-1, i, 0] = np.searchsorted(line, at[:, i, None] - half)
            out[:, :-1, i, 1] = np.searchsorted(line, at[:, i, None] + half)
        out[:, -1, :, 0], out[:, -1, :, 1] = 0, len(self.ids)  # the last radius has no end
        return out

    def nearest(self, query_id: int, query: np.ndarray, windows: np.ndarray, k: int, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest found, without the query's own row; none below ``bound`` need be found."""
        norm = np.sqrt((query * query).sum())
        n, order = len(self.ids), self.order
        hits = np.zeros(n, np.int16)
        waiting = self.ids != query_id  # not yet verified
        threshold = int(np.ceil(SHARE * PROJECTIONS))
        before = windows[0].tolist()
        found, cosine = np.empty(0, np.int64), np.empty(0)
        for radius, stretches in zip((*RADII, np.inf), windows[1:].tolist(), strict=True):
            new = []
            for i, ((low, high), (a, b)) in enumerate(zip(before, stretches, strict=True)):
                if a < low:
                    new.append(order[i, a:low])
                if high < b:
                    new.append(order[i, high:b])
            before = stretches
            if new:
                new = np.concatenate(new)
                self.counted += len(new)
                hits += np.bincount(new, minlength=n).astype(np.int16)
            met = np.flatnonzero((hits >= threshold) & waiting)
            if len(met):
                waiting[met] = False
                self.verified += len(met)
                found = np.r_[found, met]
                cosine = np.r_[cosine, (self.vectors[met] * query).sum(axis=1) / (self.norms[met] * norm)]
                best = np.lexsort((self.ids[found], -cosine))[:k]
                found, cosine = found[best], cosine[best]
            reach = max(bound, cosine[k - 1] if len(found) == k else -np.inf)
            if 2 - 2 * reach <= radius * radius:
                break
        return found, cosine


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").try_cast("long").alias("vec_id"), "embedding")
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", fine)).where(F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("embedding") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its ids, vectors and, for each projection, their order."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        shard = Shard(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()))
        return pd.DataFrame({"shard": [key[0]], "ids": [shard.ids.tobytes()], "vectors": [shard.vectors.tobytes()], "orders": [shard.order.tobytes()]})

    dealt = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    return stage(dealt.groupBy("shard").applyInPandas(build, "shard long, ids binary, vectors binary, orders binary"), "index")


def _searched(index: DataFrame, asked: DataFrame, slices: int, k: int) -> DataFrame:
    """query_id, vec_id, score, counted, verified and held (of the shard) of the k best in each shard asked.

    ``asked`` has vec_id, embedding, shard and bound.  Each shard meets the queries in ``slices``.
    """

    def search(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(queries):
            ids = np.frombuffer(shard["ids"][0], np.int64)
            held = Shard(ids, np.frombuffer(shard["vectors"][0]).reshape(len(ids), -1), np.frombuffer(shard["orders"][0], np.int32).reshape(PROJECTIONS, -1))
            for at in range(0, len(queries), 256):  # windows of so many queries at once
                part = queries[at : at + 256]
                values = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                for query_id, query, bound, windows in zip(part["vec_id"], values, part["bound"], held.windows(values), strict=True):
                    counted, verified = held.counted, held.verified
                    best, cosine = held.nearest(query_id, query, windows, k, bound)
                    work = (held.counted - counted, held.verified - verified, len(ids))
                    out += [(query_id, int(ids[b]), float(c), *work) for b, c in zip(best, cosine, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "counted", "verified", "held"])

    sliced = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).alias("slice")
    copies = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    both = copies.groupBy("shard", "slice").cogroup(asked.select("vec_id", "embedding", "shard", "bound", sliced).groupBy("shard", "slice"))
    return both.applyInPandas(search, "query_id long, vec_id long, score double, counted long, verified long, held long")


def searches(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """What ``nearest_neighbours`` merges: the bests of each query in each shard, with the work done there."""
    rows = stage(usable(vectors), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total, asking = rows.count(), queries.count()
    width = 8 * (rows.select(F.size("embedding")).first() or [1])[0]
    shards = max(1, -(-total // (shard_rows or SHARD_BYTES // width)))
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-asking * width // SLICE_BYTES), min(-(-tasks // shards), -(-asking // 64)))
    index = build_index(rows, shards)
    own = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards))
    first = _searched(index, queries.select("*", own.alias("shard"), F.lit(float("-inf")).alias("bound")), slices, k)
    if shards == 1:
        return first
    first = stage(first, "first")
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != own)
    asked = queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left")
    asked = asked.select("vec_id", "embedding", F.explode(others).alias("shard"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    return first.unionByName(_searched(index, asked, slices, k))


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row whose vec_id ``every`` divides."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = searches(vectors, every, k, shard_rows).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
