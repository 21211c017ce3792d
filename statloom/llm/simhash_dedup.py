"""Near-duplicate classes by SimHash, found with Burkhard-Keller trees.

A document's fingerprint has a bit set where over half the XXH64 hashes of its word
shingles have it set.  Documents link when their fingerprints differ in at most ``radius``
bits; classes are the connected components of these links.

Fingerprints are first made distinct, so exact copies cost one row.  They are dealt to shards
of about ``SHARD_ROWS``: the 64 bits are cut into ``radius + 1`` blocks, two fingerprints within
the radius agree wholly in at least one of them, so each goes once for every block to the shard
of some bits of that block, as many as the number of fingerprints asks for.  In each shard a
BK-tree holds the members under integer Hamming distances to their parents, and all members are
looked up in it, following only edges within the radius.

A crowded shard (over ``MOST_ROWS``, where many near copies share the bits) is dealt anew by the
choices of four of ``radius + 4`` blocks, of which two fingerprints within the radius agree in at
least one.  What is crowded still gets several trees of ``SHARD_ROWS`` members, and all its
members are looked up in each, in tasks of their own.  A tree's search hands on links that span
the groups it finds, not all pairs.

Trees are not broadcast: that would take the fingerprints of all documents through the driver.
A tree meets those that are looked up in it in a task, by their shard.

Defined results: a null or wordless text has fingerprint zero and links like any other;
rows of equal doc_id each get their row; the class id is the smallest doc_id that is not
null (null if there is none); other columns play no part, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, pieces_of, stage, whole_text
from .components import connected_components

SHARD_ROWS = 4096
MOST_ROWS = 4 * SHARD_ROWS
#: Most (query, node) pairs looked at together in a tree.
TOGETHER = 1 << 20


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        for part in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return counts


def set_in_over_half(counts: np.ndarray, n: int) -> int:
    """The 64-bit number whose bits are set in over half of n hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][shingle - 1 :]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text: A-Z lowered, words in shingles joined by one space."""
    from xxhash import xxh64_intdigest

    counts, n, kept = np.zeros(64, np.int64), 0, []
    for piece in pieces_of((text or b"").lower()):
        kept += piece.split()
        if len(kept) >= shingle:
            hashes = _shingle_hashes(kept, shingle, seed)
            counts += bit_counts(hashes)
            n += len(hashes)
            kept = kept[len(kept) - shingle + 1 :]
    if n:
        return set_in_over_half(counts, n)
    return xxh64_intdigest(b" ".join(kept), seed) if kept else 0


def fingerprints(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id and fingerprint (long, the bits of the unsigned number) of each row, and what is carried."""
    rows = docs.select(whole_text().cast("binary").alias("text"), F.struct("doc_id", *carried).alias("row"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x.as_py()) for x in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.record_batch([pa.array(found.view(np.int64)), batch.column(1)], names=["fingerprint", "row"])

    out = rows.select(F.lit(0).cast("long").alias("fingerprint"), "row").schema
    return rows.mapInArrow(mark, out).select("row.*", "fingerprint")


class BKTree:
    """Distinct fingerprints, each a node whose children are keyed by their Hamming distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        self.followed = 0  # edges, over all searches
        rest, at = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64)
        while len(rest):  # all members go down a level together; the first to come along an edge stays there
            away = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            edge, first, own = np.unique(at * 65 + away, return_index=True, return_inverse=True)
            self.child.reshape(-1)[edge] = rest[first]
            at = rest[first][own]
            on = at != rest
            rest, at = rest[on], at[on]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, member positions) that lie within the radius, level by level."""
        asked, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(asked) and len(self.values):
            away = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            close = away <= radius
            yield asked[close], node[close]
            ways = []
            for distance in (away + step for step in range(-radius, radius + 1)):
                there = np.flatnonzero((distance > 0) & (distance <= 64))
                child = self.child[node[there], distance[there]]
                ways.append((asked[there[child >= 0]], child[child >= 0]))
            asked, node = (np.concatenate(x) for x in zip(*ways, strict=True))
            self.followed += len(asked)


def hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the groups of ``label`` (least positions) along the pairs (a, b); which pairs it took."""
    left, taken = np.arange(len(a)), []
    while True:
        own, other = label[a[left]], label[b[left]]
        apart = own != other
        left, own, other = left[apart], own[apart], other[apart]
        if not len(left):
            return np.concatenate(taken) if taken else left
        moved, first = np.unique(np.maximum(own, other), return_index=True)  # one pair for each group that moves
        label[moved] = np.minimum(own, other)[first]
        taken.append(left[first])
        while len(np.flatnonzero((up := label[label]) != label)):
            label[:] = up


class ShardTree:
    """A tree with the groups among its members found so far."""

    def __init__(self, values: np.ndarray):
        self.tree = BKTree(values)
        self.label = np.arange(len(values))

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (fingerprints) that span the groups which these queries belong to or join."""
        n, step = len(self.label), max(16, TOGETHER // max(len(self.label), 1))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            label = np.r_[self.label, n + np.arange(len(part))]
            for asked, found in self.tree.within(part, radius):
                taken = hooked(label, found, n + asked)
                src, dst = part[asked[taken]], self.tree.values[found[taken]]
                yield src[src != dst], dst[src != dst]
            self.label = label[:n]


def _masks(blocks: int, chosen: int, bits: int = 64) -> list[int]:
    """The choices of so many of the blocks that 64 bits are cut into, at most so many bits of each block."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [((1 << min(b - a, bits)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, chosen)] if bits else [0]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _dealt(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(shard, fingerprint) for each mask."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return distinct.select("fingerprint", F.explode(keys).alias("shard")).select("shard", "fingerprint")


def _crowded(dealt: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(shard, n) of the shards with over ``most`` members, and how many there are."""
    found = stage(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    return found, found.count()


def sharded(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """(shard, member, fingerprint): what is looked up in each shard's tree, and whether it is in the tree.

    ``distinct`` is a staged table of distinct fingerprints.
    """
    bits = max(0, math.ceil(math.log2(max(distinct.count(), 1) / shard_rows)))
    coarse = _dealt(distinct, _masks(radius + 1, 1, bits))
    crowded, many = _crowded(coarse, most)
    if not many:
        return coarse.select("shard", F.lit(True).alias("member"), "fingerprint")
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    dense = coarse.join(small(crowded, many), "shard").select("fingerprint").distinct()
    fine = stage(_dealt(dense, _masks(radius + 4, 4)), "dense")
    still, several = _crowded(fine, most)
    split = fine.join(small(still, several), "shard", "left").withColumn("trees", F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1)))
    split = split.select("shard", "trees", "fingerprint", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"))
    split = split.select(
        F.xxhash64("shard", "tree").alias("shard"), (F.pmod(F.xxhash64("fingerprint"), "trees") == F.col("tree")).alias("member"), "fingerprint"
    )
    rest = coarse.join(small(crowded, many), "shard", "left_anti")
    return rest.select("shard", F.lit(True).alias("member"), "fingerprint").unionByName(split)


def links(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that link, enough to connect all that do."""
    rows = sharded(distinct, radius, shard_rows, most).repartition("shard").sortWithinPartitions("shard", F.desc("member"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, tree = None, [], None

        def planted() -> ShardTree:
            return ShardTree(np.concatenate(members))

        def record(found: list) -> pa.RecordBatch:
            both = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ()))]
            return pa.record_batch([pa.array(x) for x in both], names=["src", "dst"])

        for batch in batches:
            shards, own, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            found: list = []
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(shards) else []
            for a, b in zip(starts, [*starts[1:], len(shards)], strict=True):
                if shard is None or shards[a] != shard:
                    if tree is None and sum(map(len, members)) > 1:
                        tree = planted()
                        found += tree.links(tree.tree.values, radius)
                    shard, members, tree = shards[a], [], None
                mine = own[a:b]
                if mine.any():
                    members.append(values[a:b][mine])
                if not mine.all():  # members come first
                    if tree is None:
                        tree = planted() if members else ShardTree(values[:0])
                        found += tree.links(tree.tree.values, radius)
                    found += tree.links(values[a:b][~mine], radius)
            yield record(found)
        if tree is None and sum(map(len, members)) > 1:
            tree = planted()
            yield record(list(tree.links(tree.tree.values, radius)))

    return rows.mapInArrow(search, "src long, dst long").distinct()


def classes(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(fingerprint, root) of every distinct fingerprint of a staged table of fingerprints."""
    distinct = stage(marked.select("fingerprint").distinct(), "distinct")
    roots = connected_components(links(distinct, radius))
    return distinct.join(roots, F.col("fingerprint") == F.col("vertex"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicate_classes(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    marked = stage(fingerprints(docs), "fingerprints")
    rooted = stage(classes(marked, radius), "classes")
    least = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(rooted, "fingerprint")
    components = stage(least.groupBy("root").agg(F.min("least").alias("component_id")), "components")  # see components.py
    named = rooted.join(components, "root")
    return marked.join(named.select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The documents, with one of each near-duplicate class: the smallest doc_id, then text hash.

    Rows without doc_id stay only in classes where no row has one.  Repeats of the row that
    stays go.  All columns are kept as they are.
    """
    text_hash = F.xxhash64(whole_text())
    marked = stage(fingerprints(docs, text_hash.alias("text_hash")), "fingerprints")
    rooted = stage(classes(marked, radius), "classes")
    order = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")
    least = marked.groupBy("fingerprint").agg(F.min(order).alias("least")).join(rooted, "fingerprint")
    stay = least.groupBy("root").agg(F.min("least").alias("stays")).select("stays.doc_id", "stays.text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), text_hash.alias("_text"))
    kept = rows.join(stay, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text"]).select("row.*")
