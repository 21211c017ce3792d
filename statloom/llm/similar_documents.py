"""Near copies by the similarity of their word shingles, for the pipeline.

Two texts are near copies when the Jaccard similarity of their sets of ``SHINGLE``-word
shingles (A-Z lowered) is 0.8 or more; classes are the connected components of these links.
Pairs are proposed in two ways and verified by the exact similarity before they link:

SimHash fingerprints of the same shingles, linked by the BK-trees of ``simhash_dedup`` within
two bits, propose the closest.  They cannot propose all: at a similarity of 0.8 about ten of 64
bits differ, and no index of 64-bit numbers prunes at a radius that wide.

MinHash proposes the rest: ``BANDS`` bands of ``ROWS`` minima each, and texts that agree in a
band meet in a bucket.  A pair at 0.8 is missed with probability (1 - 0.8**4)**25, about two in
a million, and less above.

Texts of equal words count once.  In a bucket of n texts not all pairs are compared: first
each text with one centre (every fourth band has its own order of centres, so a dense group
meets several), then, in buckets that still hold several classes, every text outside the
largest class with all others.  The latter happens within a task, which holds the sets of one
bucket at a time, so that no row is made for a pair.  Buckets of more than ``CROWD`` texts (a
template in many texts that are not alike otherwise) are dealt anew before: near copies have one of
their rarest shingles in common (of the first fifth and one more, in an order that all sets
share), so texts that share such a one meet instead, which loses no pair and leaves templates out.

Defined results: a text shorter than a shingle is one shingle; wordless texts are near
copies of each other; a text is known by 64 bits of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_dedup
from ._shared import stage, whole_text
from .components import connected_components
from .substring_dedup import _MULTIPLIER, Words, _groups, _mixed

SHINGLE = 5
BANDS = 25
ROWS = 4
#: Orders of centres among the bands.
CENTRES = 4
#: Texts of a bucket that are compared within a task at most.
CROWD = 2048

_SEEDS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MULTIPLIER)


def _shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of texts that have at least one, in the order of the texts."""
    n = len(words.hash) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        grams = grams * _MULTIPLIER + words.hash[i : n + i]
    inside = np.flatnonzero(words.text[:n] == words.text[SHINGLE - 1 :])
    return words.text[inside], _mixed(grams[inside])


def band_keys(texts: list[bytes], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bands of each text (a row for each), and its SimHash; ``names`` stand for texts without a shingle."""
    words = Words(texts)
    of, grams = _shingle_hashes(words)
    short = np.flatnonzero(words.counts < SHINGLE)
    of, grams = np.r_[of, short], np.r_[grams, _mixed(names[short])]
    order = np.argsort(of, kind="stable")
    of, grams = of[order], grams[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        least = np.minimum.reduceat(_mixed((grams ^ seed) * _MULTIPLIER), starts)
        keys[:, i // ROWS] = keys[:, i // ROWS] * _MULTIPLIER + least
    prints = np.zeros(len(texts), np.uint64)
    for text, a, b in zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
        prints[text] = simhash_dedup.set_in_over_half(simhash_dedup.bit_counts(grams[a:b]), b - a)
    return _mixed(keys * _MULTIPLIER + np.arange(1, BANDS + 1, dtype=np.uint64)), prints


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    joined = [b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, min(len(words), 1)))]
    return np.unique(np.fromiter(map(xxh3_64_intdigest, joined), np.uint64, len(joined)))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (its words' hash), fingerprint and bands of each row."""
    from xxhash import xxh3_64_intdigest

    rows = docs.select(whole_text().cast("binary").alias("text"), F.struct("doc_id", F.xxhash64(whole_text()).alias("text_hash")).alias("row"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(0)):
                texts = [t.lower() for t in texts]
                names = np.fromiter((xxh3_64_intdigest(b" ".join(t.split())) for t in texts), np.uint64, len(texts))
                keys, prints = band_keys(texts, names)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                columns = [batch.column(1).slice(first, len(texts)), pa.array(names.view(np.int64)), pa.array(prints.view(np.int64)), bands]
                yield pa.record_batch(columns, names=["row", "node", "fingerprint", "bands"])

    number = F.lit(0).cast("long")
    out = rows.select("row", number.alias("node"), number.alias("fingerprint"), F.array().cast("array<long>").alias("bands")).schema
    return rows.mapInArrow(mark, out).select("row.*", "node", "fingerprint", "bands")


def meetings(marked: DataFrame) -> DataFrame:
    """(bucket, band, node) of the buckets with several nodes, as a staged table."""
    nodes = stage(marked.groupBy("node").agg(F.first("bands").alias("bands")), "nodes")
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return stage(placed.join(stage(several, "several"), "bucket").select("bucket", "band", "node"), "meetings")


def shingle_sets(docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes given, from one row of each."""
    wanted = marked.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    wanted = stage(wanted.select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash")), "wanted")
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(whole_text()).alias("_text"), whole_text().cast("binary").alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                sets = [shingles(t).view(np.int64) for t in texts]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    # Rows that repeat meet here again, once for each row.
    sets = rows.join(wanted, same).select("node", "text").mapInArrow(cut, "node long, shingles array<long>")
    return stage(sets.dropDuplicates(["node"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose similarity is 0.8 or more, as a staged table."""
    own = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(own("src"), "src").join(own("dst"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    # shared / (a + b - shared) >= 4 / 5
    close = 9 * shared >= 4 * (F.size("src_set") + F.size("dst_set"))
    return stage(both.where(close).select("src", "dst"), "links")


def _across(nodes: np.ndarray, roots: np.ndarray, ends: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Near copies among a bucket's texts that connect its classes; text i has values[ends[i] : ends[i + 1]]."""
    _, values = np.unique(values, return_inverse=True)
    _, of = np.unique(roots, return_inverse=True)
    largest, sizes = np.argmax(np.bincount(of)), np.diff(ends)
    own = np.zeros(values.max(initial=-1) + 1, bool)
    for i in np.flatnonzero(of != largest):  # texts of the largest class are found by the others
        mine = values[ends[i] : ends[i + 1]]
        own[mine] = True
        sums = np.r_[0, np.cumsum(own[values])]
        own[mine] = False
        close = 9 * (sums[ends[1:]] - sums[ends[:-1]]) >= 4 * (sizes[i] + sizes)
        for j in np.flatnonzero(close & (of != of[i])):
            if of[j] != of[i]:
                yield int(nodes[i]), int(nodes[j])
                of[of == of[j]] = of[i]


def linked_across(members: DataFrame) -> DataFrame:
    """Edges (src, dst) of near copies in different classes of a bucket, of rows (bucket, node, root, shingles).

    Sets travel once for each bucket of theirs, not once for each pair.
    """
    rows = members.select("bucket", "node", "root", "shingles").repartition("bucket").sortWithinPartitions("bucket")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            bucket, node, root = (part.column(i).to_numpy() for i in range(3))
            lengths = np.r_[0, *[c.value_lengths().to_numpy() for c in part.column(3).chunks]].astype(np.int64)
            values = np.concatenate([c.flatten().to_numpy() for c in part.column(3).chunks])
            ends = np.cumsum(lengths)
            edges = []
            cuts = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                edges += _across(node[a:b], root[a:b], ends[a : b + 1] - ends[a], values[ends[a] : ends[b]])
            src, dst = zip(*edges, strict=True) if edges else ((), ())
            return pa.record_batch([pa.array(x, pa.int64()) for x in (src, dst)], names=["src", "dst"])

        kept = []  # the rows of a bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(0).to_numpy()
            whole = int(np.searchsorted(buckets, buckets[-1]))
            if kept and buckets[0] != kept[-1].column(0)[0].as_py():
                yield found(pa.Table.from_batches(kept))
                kept = []
            if whole:
                yield found(pa.Table.from_batches([*kept, batch.slice(0, whole)]))
                kept = []
            kept.append(batch.slice(whole))
        if kept:
            yield found(pa.Table.from_batches(kept))

    return rows.mapInArrow(search, "src long, dst long").distinct()


def rare_meetings(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, node, root) of nodes (node, root) that share a shingle among the rarest of each, where they are of several classes."""
    each = crowded.join(sets, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    each = stage(each, "each")  # plain tables, so that a hot shingle can be split
    often = stage(each.groupBy("shingle").agg(F.count("*").alias("often")), "often")
    order = Window.partitionBy("node").orderBy("often", "shingle")
    first = each.join(often, "shingle").where("often > 1").withColumn("place", F.row_number().over(order))
    alone = each.join(often, "shingle").where("often = 1").groupBy("node").agg(F.count("*").alias("alone"))  # they come first, and meet nothing
    first = first.join(alone, "node", "left").where(F.expr("place + coalesce(alone, 0) <= n - (4 * n + 4) div 5 + 1"))
    first = stage(first.select(F.col("shingle").alias("bucket"), "node", "root"), "rare")
    several = first.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket")
    return first.join(stage(several, "several"), "bucket")


def closest(marked: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes whose fingerprints link, as a staged table.

    A fingerprint is stood for by its least node; other nodes of it pair with that one.
    """
    nodes = marked.select("node", "fingerprint").distinct()
    least = stage(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")), "least")
    alike = nodes.join(least, "fingerprint").where("node > least").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    edges = stage(simhash_dedup.links(least.select("fingerprint")), "edges")
    named = lambda end: least.select(F.col("fingerprint").alias(end), F.col("least").alias(f"{end}_node"))
    linked = edges.join(named("src"), "src").join(named("dst"), "dst")
    linked = linked.select(F.least("src_node", "dst_node").alias("src"), F.greatest("src_node", "dst_node").alias("dst"))
    return stage(alike.unionByName(linked).distinct(), "closest")


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes, enough to connect all near copies that meet."""
    met, close = meetings(marked), closest(marked)
    both = F.explode(F.array("src", "dst")).alias("node")
    sets = shingle_sets(docs, marked, met.select("node").unionByName(close.select(both)).distinct())
    order = F.struct(F.xxhash64("node", F.col("band") % CENTRES).alias("at"), "node")
    centres = stage(met.groupBy("bucket").agg(F.min(order)["node"].alias("centre")), "centres")
    first = met.join(centres, "bucket").where("node <> centre")
    first = first.select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst"))
    first = stage(first.unionByName(close).distinct(), "pairs")
    found = verified(first, sets)

    roots = stage(connected_components(found), "roots")
    rooted = met.join(roots, F.col("node") == F.col("vertex"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
    apart = stage(apart.where("a < b and n > 2").select("bucket", "n"), "apart")  # two texts have met already
    members = stage(rooted.join(apart, "bucket"), "members")
    crowded = members.where(F.col("n") > CROWD).select("node", "root").distinct()
    members = members.where(F.col("n") <= CROWD).drop("n")
    if not crowded.isEmpty():
        members = members.unionByName(stage(rare_meetings(stage(crowded, "crowded"), sets), "rare-members"))
    return found.unionByName(stage(linked_across(members.join(sets, "node")), "links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with one of each class of near copies: the smallest doc_id, then text hash.

    Rows without doc_id stay only in classes where no row has one.  Repeats of the row that
    stays go.  All columns are kept as they are.
    """
    marked = stage(marks(docs), "marks")
    roots = stage(connected_components(links(docs, marked)), "roots")
    order = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")
    least = marked.groupBy("node").agg(F.min(order).alias("least"))
    rooted = least.join(roots, F.col("node") == F.col("vertex"), "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("stays")).select("stays.doc_id", "stays.text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64(whole_text()).alias("_text"))
    kept = rows.join(stay, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text"]).select("row.*")
