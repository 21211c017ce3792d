"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt by a hash to buckets (the source partitions).  How many rows each bucket sends to
each shard is drawn exactly, from the multivariate hypergeometric law that a uniform shuffle has;
this matrix (buckets x shards) is all the driver sees.  Each bucket permutes its rows and cuts
them by its row of the matrix; after the exchange each shard permutes what it got, in cells whose
sizes are counted first, so that no task orders a whole shard.  Buckets and cells grow with the
rows, up to ``MOST_BUCKETS`` and ``MOST_CELLS``.

Defined results: an empty table gives no rows; a null text has size 8 and the checksum of
the empty text; rows that repeat each get a place of their own; null ids are rows like any
other; columns shard and slot of the input are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._shared import BROADCAST_ROWS, stage, whole_text

LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 14
LEAST_CELLS, MOST_CELLS = 64, 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, out of good and bad ones without replacement, are good.

    Inversion outwards from the mode: exact up to rounding, in about as many steps as the
    standard deviation, for counts of any size.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    fact = lambda n: math.lgamma(n + 1)
    choose = lambda n, k: fact(n) - fact(k) - fact(n - k)
    at_mode = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, drawn as a uniform shuffle would give them."""
    rng, left = random.Random(seed), list(columns)
    matrix = []
    for size in rows:
        line, rest, todo = [], sum(left), size
        for j, column in enumerate(left):
            rest -= column
            drawn = todo if j == len(left) - 1 else hypergeometric(rng, column, rest, todo)
            line.append(drawn)
            todo -= drawn
        left = [a - b for a, b in zip(left, line, strict=True)]
        matrix.append(line)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def groups_for(rows: int, least: int, most: int) -> int:
    return min(most, max(least, -(-rows // _shared.GROUP_ROWS)))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (row, key), staged; keys that more than ``GROUP_ROWS`` rows share become keys of each row's own."""
    rows = stage(rows.withColumn("place", F.monotonically_increasing_id()), "repeated")
    hot = rows.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > _shared.GROUP_ROWS).select(F.col("key").alias("hot"))
    known = F.broadcast(hot) if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hot
    joined = rows.join(known, F.col("key") == F.col("hot"), "left")
    return joined.select("row", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64("key", "place")).alias("key"))


def shuffle_into_shards(df: DataFrame, key: Column, shards: int, seed: int = 20) -> DataFrame:
    """The rows with ``shard`` and ``slot``: a uniform shuffle, shard sizes at most one apart.

    ``key`` tells rows apart (a hash of their content); rows with equal keys are placed in
    an order of their own, and where they crowd a bucket they are told apart by where they lie.
    ``df`` is read three times, so it should be a plain table.
    """
    spark = df.sparkSession
    rows = df.select(F.struct("*").alias("row"), key.alias("key"))
    total = df.count()
    buckets, cells = groups_for(total, LEAST_BUCKETS, MOST_BUCKETS), groups_for(total // shards, LEAST_CELLS, MOST_CELLS)
    in_bucket = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", in_bucket)
    counts = dict(rows.groupBy("bucket").count().collect())  # at most MOST_BUCKETS rows
    if max(counts.values(), default=0) > 2 * max(_shared.GROUP_ROWS, total // buckets):
        rows = _apart(rows.select("row", "key")).withColumn("bucket", in_bucket)
        counts = dict(rows.groupBy("bucket").count().collect())
    sizes = [counts.get(b, 0) for b in range(buckets)]
    matrix = communication_matrix(sizes, shard_sizes(sum(sizes), shards), seed)
    ends = pa.array([list(accumulate(line)) for line in matrix], pa.list_(pa.int64()))
    table = spark.createDataFrame(pa.table([pa.array(range(buckets), pa.int32()), ends], names=["bucket", "ends"]))  # a local relation

    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key")
    sent = (
        rows.withColumn("place", F.row_number().over(local) - 1)
        .join(small(table, buckets), "bucket")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
        .withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(cells)).cast("int"))
        .select("row", "key", "shard", "cell")
    )
    sent = stage(sent, "sent")
    held = sent.groupBy("shard", "cell").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy(F.xxhash64(F.lit(seed + 3), "key"), "key")
    placed = sent.withColumn("nth", F.row_number().over(within) - 1).join(small(starts, shards * cells), ["shard", "cell"])
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """The documents, text and all, with shard and slot."""
    return shuffle_into_shards(docs, F.xxhash64("doc_id", whole_text()), shards, seed)
