"""Packing token sequences by minimum bin slack.

For a bin seeded with the longest piece left, a subset-sum dynamic programme over the
lengths still available (a bit for each reachable sum, in one big integer) finds the fullest
combination that fits, and that combination is removed.  Only the number of pieces of each
length matters for this, at most one count for each length up to the capacity, so the
driver sees a bounded table however large the corpus is; a combination found is removed as
often as the counts allow, so there are about as many combinations as lengths.  Pieces are
then numbered within their length, in slices so that a hot length is no hot task (slices that
equal pieces crowd are dealt out once more), and each number has its place in one of the combinations.

``token_pieces`` gives each piece with its ids, ``pack`` places pieces, ``sequences`` puts the
ids of each sequence together.

Defined results: a null or empty text is the end id alone; documents longer than a sequence
are cut into full pieces and a rest, others stay whole; rows that repeat are packed each;
columns of the documents other than doc_id and text play no part, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import spread, stage
from .tokenizing import WordTokenizer

CAPACITY = 2048
END_ID = 0
SLICES = 1024
#: Bytes of ids that a task brings together before it passes them on.
TOGETHER = 4 << 20


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination with the longest length available: length to how often."""
    first = max(counts)
    room = capacity - first
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    whole = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for n in lengths:
        most = min(counts[n] - (n == first), room // n)
        times = 1
        while most > 0:  # a length's copies in groups of 1, 2, 4 and the rest
            take = min(times, most)
            grown = reached | (reached << (n * take)) & whole
            if grown != reached:
                steps.append((n, take, reached))
                reached = grown
            most -= take
            times *= 2
        if reached >> room:
            break
    total = reached.bit_length() - 1
    found = {first: 1}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            found[n] = found.get(n, 0) + take
            total -= n * take
    return found


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) that use up all counts."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        found = fullest(left, capacity)
        times = min(left[n] // m for n, m in found.items())
        out.append((times, found))
        for n, m in found.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, copies in the bin, first sequence, offset in the bin)."""
    table: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in found:
        offset = 0
        for n, m in sorted(lengths.items(), reverse=True):
            table.setdefault(n, []).append((used.get(n, 0), m, sequence, offset))
            used[n] = used.get(n, 0) + times * m
            offset += n * m
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in table.items()}


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids of the pieces of each row's ids and end id.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of_worker(path)

        def full(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            which, piece, start, length, ids = zip(*found, strict=True) if found else ((),) * 5
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            return pa.record_batch([*columns, pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            found, held = [], 0
            for row, text in enumerate(batch.column(1)):
                ids = tokenizer.encode(text.as_py()) + end
                for at in range(0, len(ids) // 4, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    found.append((row, at // capacity, at, len(part) // 4, part))
                held += len(ids)
                if held >= TOGETHER:
                    yield full(batch, found)
                    found, held = [], 0
            yield full(batch, found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a staged table of pieces (with ``place``, a number of each row's own) with sequence_id and offset."""
    names = [c for c in pieces.columns if c != "place"]
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = places(combinations(counts, capacity))

    key = F.xxhash64("doc_id", "piece", "ids")
    sliced = spread(pieces.withColumn("slice", F.pmod(key, F.lit(SLICES)).cast("int")), ["length", "slice"])
    held = sliced.groupBy("length", "slice", "sub").agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("slice", "sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("length", "slice", "sub", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "slice", "sub").orderBy("doc_id", "piece", F.xxhash64("ids"), "place")
    numbered = (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(firsts, ["length", "slice", "sub"])
        .select(*names, (F.col("first") + F.col("nth")).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                rows = table[int(n)]
                first, copies, seq, off = rows[np.searchsorted(rows[:, 0], numbers[at], "right") - 1].T
                turn, copy = np.divmod(numbers[at] - first, copies)
                sequence[at], offset[at] = seq + turn, off + copy * n
            kept = [batch.column(c) for c in names]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of every sequence, from packed pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most its capacity
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document with its ids and place: sequence_id and offset in it."""
    pieces = token_pieces(docs, capacity, path).withColumn("place", F.monotonically_increasing_id())
    return pack(stage(pieces, "pieces", "zstd"), capacity)  # two of four bytes of an id are mostly 0
