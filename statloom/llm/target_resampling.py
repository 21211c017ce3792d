"""Resampling documents towards a target distribution, by importance weights of hashed n-grams.

Identical texts are collapsed by grouping whole texts: each distinct text is cut into words and
its features (runs of 1 to ``RUN`` words, hashed to ``BUCKETS`` buckets) are counted once.  Bucket
counts of the corpus are the counts of the distinct texts times their copies.  The weight of a
text is the sum of its features' gains, the logarithm of how much likelier a bucket is in the
target than in the corpus; it is joined back to every document by the digest of its text, and
only then comes the noise of the single document.  The documents with the highest sums are drawn
(Gumbel top-k, which samples without replacement in proportion to the weights).

Features are kept as the distinct buckets of a text, with their counts, so that a text of any
length takes a bounded row.  Long texts are cut into words in pieces.  Ranks are numbered within
ranges of the score.

Defined results: null texts are empty; texts without words have no feature and weigh 0; rows
that repeat are documents of their own; equal scores are ranked by doc_id, documents without one
last, then by text, and rows alike in all of this in any order; the noise of a document without
doc_id is that of an empty id; an empty target or corpus counts no features; other columns play
no part; no documents give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import pieces_of, stage, whole_text

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
#: Texts whose features a worker holds at once.
PART = 512

#: Words of UTF-8 in lower case: digits, letters a to z, and all that is beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features_of(text: bytes, piece: int = 1 << 20) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(number of words, number of features, distinct buckets, count of each) of a text."""
    n_words, before, found, held = 0, [], [], 0
    whole = np.zeros(BUCKETS, np.int64)
    for part in pieces_of(text, piece):
        new = _WORD.findall(part.lower())
        n_words += len(new)
        words = before + new
        after = [b" " + word for word in words]
        hashes = list(map(crc32, words))
        for run in range(1, RUN + 1):  # hashes[i]: of the run that ends at word run - 1 + i
            if run > 1:
                hashes = list(map(crc32, after[run - 1 :], hashes))
            found.append(np.array(hashes[max(0, len(before) - run + 1) :], np.int64) % BUCKETS)
            held += len(found[-1])
        before = words[-(RUN - 1) :]
        if held > 1 << 20:
            whole += np.bincount(np.concatenate(found), minlength=BUCKETS)
            found, held = [], 0
    buckets = np.concatenate(found) if found else np.empty(0, np.int64)
    if whole.any():
        whole += np.bincount(buckets, minlength=BUCKETS)
        buckets = np.flatnonzero(whole)
        counts = whole[buckets]
    else:
        buckets, counts = np.unique(buckets, return_counts=True)
    return n_words, int(counts.sum()), buckets, counts


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``PART`` rows: a worker holds the numbers of one part."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def text_features(texts: DataFrame) -> DataFrame:
    """digest, copies, n_words, n_features, buckets and counts of the distinct texts, staged.

    ``buckets`` holds the steps from each distinct bucket to the next, which compress well.
    """
    distinct = texts.select(whole_text().alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def pack(text: bytes) -> tuple[int, int, bytes, bytes]:
        n_words, n_features, buckets, counts = features_of(text)
        return n_words, n_features, np.diff(buckets, prepend=0).astype("<u2").tobytes(), counts.astype("<u4").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            found = [pack(text.as_py()) for text in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.record_batch([batch.column("digest"), batch.column("copies"), *columns], names=["digest", "copies", "n_words", "n_features", "buckets", "counts"])

    rows = distinct.select(digest_of(F.col("text")).alias("digest"), "copies", F.col("text").cast("binary").alias("text"))
    kinds = "digest binary, copies long, n_words long, n_features long, buckets binary, counts binary"
    return stage(rows.mapInArrow(count, kinds), "features", codec="zstd")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, count) of the features of a batch."""
    steps = batch.column("buckets").to_pylist()
    lengths = np.array([len(x) // 2 for x in steps], np.int64)
    upto = np.frombuffer(b"".join(steps), "<u2").astype(np.int64).cumsum()
    bases = np.r_[0, upto][np.r_[0, lengths.cumsum()[:-1]]] if len(lengths) else lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text, upto - bases[text], np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").astype(np.int64)


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How often each bucket occurs over all copies: at most ``BUCKETS`` numbers reach the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in _in_parts(batches):
            text, bucket, count = _unpacked(batch)
            np.add.at(total, bucket, count * batch.column("copies").to_numpy()[text])
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    parts = features.select("copies", "buckets", "counts").mapInArrow(summed, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, both distributions smoothed by one a bucket."""
    of_corpus, of_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * of_corpus / ((s + 1.0) * of_target)))
    return np.array([gain(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """digest, n_words, n_features and weight of the distinct texts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            text, bucket, count = _unpacked(batch)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, text, gains[bucket] * count)
            yield pa.record_batch([*(batch.column(c) for c in ("digest", "n_words", "n_features")), pa.array(weight)], names=["digest", "n_words", "n_features", "weight"])

    rows = features.select("digest", "n_words", "n_features", "buckets", "counts")
    return rows.mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long")


def noise() -> Column:
    """Gumbel noise of a document, in thousandths."""
    key = F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) and n_words of every document."""
    features = text_features(docs)
    gains = bucket_gains(bucket_counts(features), bucket_counts(text_features(target)))
    known = docs.select("doc_id", digest_of(whole_text()).alias("digest"))
    scored = known.join(text_weights(features, gains), "digest")
    scored = scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise()).alias("score"), "n_words", "digest", F.monotonically_increasing_id().alias("place"))
    scored = stage(scored, "scores")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "digest", "place"]
    ranged = stage(scored.repartitionByRange(able.desc(), *order).withColumn("range", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = ranged.groupBy("range").agg(F.count_if(able).alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(able.desc(), *order))
    ranked = ranged.withColumn("within", within).join(bases, "range")
    rank = F.col("base") + F.col("within")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(able & (rank <= drawn), rank).alias("rank"), "n_words")
