"""Clustering of integer vectors around centroids, with block-norm screening.

A vector of ``LENGTH`` components is kept as integers, floor(256 * x), and beside them as a
compressed vector: the norms of its ``SEGMENTS`` segments, worked out once and staged.  By
Cauchy-Schwarz a segment of a vector and that of a centroid are at least as far apart as their
norms, so the squared differences of norms add up to a lower bound of the squared distance.  A
vector first meets the centroid of the least bound; of the others only those whose bound does
not exceed the best distance so far get an exact integer distance.

Each round is one pass over the staged vectors; a task sums what it assigns before anything is
shuffled, and the driver sees a count and a sum for each centroid and component.  Centroids move
to the exact floor of the mean; a centroid without vectors stays where it is.

Defined results: vectors that are null, of another length, or hold a null or a number that is
not finite take no part, nor do those with a component beyond ``LARGEST`` (a squared distance
would not fit a long); every row is a vector of its own, so rows that repeat count as often, and
rows without vec_id take part but start no centroid unless there are too few others; ties go to
the smaller centroid; with fewer vectors than centroids there are as many centroids as vectors;
sums that do not fit a long are null; other columns play no part; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage

LENGTH = 64
SEGMENTS = 8
CENTROIDS = 40
ROUNDS = 5
#: The largest integer component, and the part of a bound that rounding of doubles may cost.
LARGEST = 1 << 27
SLACK = 1e-9


def segment_norms(vectors: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row."""
    parts = vectors.astype(np.float64).reshape(len(vectors), SEGMENTS, -1)
    return np.sqrt((parts * parts).sum(axis=2))


def assigned(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, and how many exact distances that took."""
    bounds = np.zeros((len(vectors), len(centroids)))
    for at, line in enumerate(segment_norms(centroids).T):
        bounds += (norms[:, at, None] - line) ** 2
    bounds *= 1 - SLACK
    squared = lambda rows, to: ((d := vectors[rows] - to) * d).sum(axis=1)
    nearest = bounds.argmin(axis=1)
    distance = squared(slice(None), centroids[nearest])
    first, exact = nearest.copy(), len(vectors)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, number] <= distance) & (first != number))
        exact += len(rows)
        found = squared(rows, centroid)
        better = (found < distance[rows]) | ((found == distance[rows]) & (number < nearest[rows]))
        nearest[rows[better]], distance[rows[better]] = number, found[better]
    return nearest, distance, exact


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, the integer components and the segment norms of the vectors that take part, staged."""
    row = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    row = row.where(F.size("embedding") == LENGTH).where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST / 256)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(256 * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, LENGTH)).astype("<i4")
            columns = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (values, segment_norms(values))]
            yield pa.record_batch([batch.column(0), *columns], names=["vec_id", "components", "norms"])

    kind = row.schema["vec_id"].dataType.simpleString()
    return stage(row.mapInArrow(pack, f"vec_id {kind}, components binary, norms binary"), "vectors")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    read = lambda name, kind, width: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)
    return read("components", "<i4", LENGTH).astype(np.int64), read("norms", "<f8", SEGMENTS)


def first_centroids(rows: DataFrame, count: int) -> np.ndarray:
    """The ``count`` vectors with the smallest sha256 of ``2:<vec_id>``, in that order."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(digest.asc_nulls_last(), "components").limit(count).select("components").collect()
    return np.array([np.frombuffer(r["components"], "<i4") for r in chosen], np.int64).reshape(-1, LENGTH)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floors of the means of what is nearest to each."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), LENGTH), np.int64)
        for batch in batches:
            vectors, norms = _arrays(batch)
            nearest = assigned(vectors, norms, centroids)[0]
            counts += np.bincount(nearest, minlength=len(centroids))
            np.add.at(sums, nearest, vectors)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(np.c_[counts, sums][some].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = rows.mapInArrow(summed, "cluster long, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r["cluster"], r["at"]): int(r["total"]) for r in sums}
    return np.array([[total[i, 1 + k] // total[i, 0] for k in range(LENGTH)] if (i, 0) in total else line.tolist() for i, line in enumerate(centroids)], np.int64)


def clusters(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and distance of every vector that takes part; the final centroids)."""
    rows = prepared(vectors)
    centroids = first_centroids(rows, count)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance, _ = assigned(*_arrays(batch), centroids)
            yield pa.record_batch([batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), centroids


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    found, centroids = clusters(vectors, count, rounds)
    found = stage(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row a centroid
    total = {r["cluster"]: int(r["total"]) for r in sums}
    as_long = lambda n: n if n < 1 << 63 else None
    digest = lambda line: hashlib.sha256(",".join(map(str, line.tolist())).encode()).hexdigest()
    lines = [(i, as_long(n), as_long(sum(total.values())), digest(centroids[i])) for i, n in sorted(total.items())]
    about = vectors.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds as one table expression each: exact, as all integers here are below 2^53 as doubles."""
    floor = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
    fine = f"len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(CAST(x AS DOUBLE)) <= {LARGEST // 256})) = {LENGTH}"
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, {floor} AS v FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {CENTROIDS})",
    ]
    for n in range(ROUNDS + 1):
        pairs = f"SELECT vec_id, v, cluster, CAST(list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS BIGINT) AS d FROM kept CROSS JOIN c{n}"
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, v, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS place FROM ({pairs})) WHERE place = 1)")
        if n < ROUNDS:
            parts = f"SELECT cluster, unnest(range({LENGTH})) AS i, unnest(v) AS x FROM a{n}"
            means = f"SELECT cluster, list(floor(s / n) ORDER BY i) AS m FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM ({parts}) GROUP BY cluster, i) GROUP BY cluster"
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m, c) AS c FROM c{n} LEFT JOIN ({means}) means ON means.cluster = c{n}.cluster)")
    digest = "sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))"
    return f"""WITH {', '.join(out)}
SELECT vec_id, a{ROUNDS}.cluster AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, {digest} AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = a{ROUNDS}.cluster"""


ORACLE_SQL = _oracle()
