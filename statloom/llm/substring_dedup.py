"""Substring dedup with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of a document.  Words covered by a window that
also starts earlier (smaller doc_id, or earlier in the same document) are removed.

Documents come in batches.  A batch's fingerprints form an immutable run: a table bucketed and
sorted by hash.  A new batch's run is merge-joined with the runs of the history, bucket by bucket
without a shuffle of the history; a window found there, or earlier in its own batch, is a repeat.
Then the run joins the history; where ``FAN_OUT`` runs have gathered those of about a size are
compacted, before the next batch, into one that keeps each fingerprint's earliest place.  The index lies in a folder that can be opened
again, so that a later batch meets all that came before (``FingerprintIndex``, ``deduplicated``).

Every window of every document is in the index, most of them folded: a window names the least
hash among its runs of ``ANCHOR`` words, its anchor, and neighbouring windows mostly share theirs,
so an index row holds an anchor with the checks (32 bits of another hash, of the whole window) of
the windows around it.  Equal windows have equal anchors.  Only where an anchor is met again, in
the batch or in the history, are its rows unfolded to windows, which are then matched by anchor
and check.  An anchor with several places in one task is unfolded there: windows that repeat
within the task are known to do so, the others travel under hashes of their own, so a passage in
a third of all documents is no hot key.  Exact copies of a whole document need no windows: all
their words repeat if they have as many as a window.

Joins of texts are sort-merge joins at every size: the other side grows with the corpus.

Windows are compared by 96 bits of their words.  The words themselves are compared once more for
the repeats that go: a stretch of repeated windows must have the same digest as the stretch of the
earlier document that it repeats; one that has not stays (``verified``).

Defined results: a null text has no words; documents with fewer words than a window keep
all; rows of equal doc_id are one document in the order (equal rows do not remove each
other); rows whose doc_id is no whole number come last, in the order of a hash of it, and rows
without doc_id in that of a hash of their text, those of equal text as one document; other columns are kept or play no part, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import pieces_of, shared_dir, shuffles_freed, stage, whole_text

WINDOW = 20
ANCHOR = 10
BATCHES = 3
FAN_OUT = 2
#: Times the rows of later runs that a run may have to be merged with them.
TIER = 4
#: Texts hashed at once, in bytes; longer texts are hashed in pieces of that size.
GROUP = 1 << 20
#: Windows that a task brings together before it passes them on.
TOGETHER = 1 << 18
#: Keys of rows without doc_id begin here.
UNNAMED = 1 << 62
#: What an index row stands for.
FOLDED, SINGLE, KNOWN = 0, 1, 2
_RUN = "route long, kind int, key long, start int, checks array<int>"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHECK_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_BYTE_MULTIPLIER = np.uint64(0x5851F42D4C957F2D)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BYTE_MULTIPLIER), -1, 1 << 64))
        for i, base in enumerate((_BYTE_MULTIPLIER, inverse)):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts, one text after another: where they are and a hash of each."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.array([len(ws) for ws in split], np.int64)
        self.joined = b" ".join([b" ".join(ws) for ws in split if ws])
        data = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(data == 32)
        n = int(self.counts.sum())
        self.starts = np.r_[0, gaps + 1][:n]
        self.ends = np.r_[gaps, len(data)][:n]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]] if len(texts) else np.empty(0, np.int64)
        power, inverse = _powers(len(data) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(data * power[: len(data)], dtype=np.uint64)]
        self.hash = _mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def windows(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, anchor's hash, check) of every window."""
        n = len(self.hash)
        if n < window:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        grams = np.zeros(n - anchor + 1, np.uint64)
        for i in range(anchor):
            grams = grams * _MULTIPLIER + self.hash[i : n - anchor + 1 + i]
        grams = _mixed(grams)
        least = grams[: n - window + 1].copy()
        for i in range(1, window - anchor + 1):
            np.minimum(least, grams[i : n - window + 1 + i], out=least)
        checks = np.zeros(n - window + 1, np.uint64)
        for i in range(window):
            checks = checks * _CHECK_MULTIPLIER + self.hash[i : n - window + 1 + i]
        words = np.flatnonzero(self.text[: n - window + 1] == self.text[window - 1 :])
        return words, least[words].view(np.int64), (_mixed(checks[words]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) of an Arrow column, in groups of about GROUP bytes."""
    first, group, held = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py() or b""
        if group and held + len(text) > GROUP:
            yield first, group
            first, group, held = i, [], 0
        group.append(text)
        held += len(text)
    if group:
        yield first, group


def _parts(column: pa.Array, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, place of the first word, text) of about GROUP bytes; long texts in pieces that overlap by a window less a word."""
    group, held = [], 0
    for row, x in enumerate(column):
        kept, upto = b"", 0
        for piece in pieces_of(x.as_py() or b"", GROUP):
            if held + len(piece) > GROUP and group:
                yield group
                group, held = [], 0
            whole = kept + b" " + piece if kept else piece
            group.append((row, upto, whole))
            held += len(whole)
            if len(piece) >= GROUP:  # more may follow
                words = whole.split()
                tail = words[max(len(words) - window + 1, 0) :]
                kept, upto = b" ".join(tail), upto + len(words) - len(tail)
    if group:
        yield group


def key_of() -> Column:
    """A row's place in the order of documents."""
    unnamed = F.lit(UNNAMED) + F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), whole_text())), F.lit(1 << 61))
    return F.coalesce(F.col("doc_id").try_cast("long"), unnamed)


def keyed(docs: DataFrame) -> DataFrame:
    """key (place in the order) and text as bytes of the rows."""
    return docs.select(key_of().alias("key"), whole_text().alias("text"))


def in_order(h: np.ndarray, check: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows by (h, key, start). Neighbours mostly share h, so that runs of them are sorted, not each."""
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
    lengths = np.diff(np.r_[first, len(h)])
    by = np.lexsort((start[first], key[first], h[first]))
    first, lengths = first[by], lengths[by]
    order = np.repeat(first - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(h))
    sorted_ = h[order], check[order], key[order], start[order]
    h_, _, key_, start_ = sorted_
    if ((h_[1:] == h_[:-1]) & (key_[1:] == key_[:-1]) & (start_[1:] <= start_[:-1])).any():  # rows of equal key, whose runs overlap
        order = np.lexsort((start, key, h))
        sorted_ = h[order], check[order], key[order], start[order]
    return sorted_


def window_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Index rows (route, kind, key, start, checks) of the windows of rows (key, text as bytes)."""

    def told(parts: list) -> pa.RecordBatch:
        h, check, key, start = in_order(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        # Windows of an anchor and check, in no order; the first of them is the one of the least position.
        whole = (np.cumsum(np.r_[False, h[1:] != h[:-1]]) << 32) | check.view(np.uint32).astype(np.int64)
        order = np.argsort(whole)
        same = np.flatnonzero(np.r_[True, np.diff(whole[order]) != 0])
        head = np.empty(len(h), np.int64)
        head[order] = np.repeat(np.minimum.reduceat(order, same), np.diff(np.r_[same, len(h)]))
        new = head == np.arange(len(h))
        known = np.flatnonzero(~new)
        known = known[(key[known] != key[head[known]]) | (start[known] != start[head[known]])]  # equal rows count once
        whose, where = key[head[known]], start[head[known]].astype(np.int32)
        key_known, start_known = key[known], start[known]
        h, check, key_, start_ = h[new], check[new], key[new], start[new]
        other = np.r_[True, h[1:] != h[:-1]]
        run = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (key_[1:] != key_[:-1]) | (start_[1:] != start_[:-1] + 1)])
        of = np.cumsum(other) - 1  # which anchor
        places = np.bincount(of[run])
        busy = places[of] > 1
        ends = np.r_[run[1:], len(h)]
        folded, single, marker = run[~busy[run]], np.flatnonzero(busy), np.flatnonzero(other & busy)
        lengths = np.r_[(ends - run)[~busy[run]], np.ones(len(single), np.int64), np.zeros(len(marker) + len(known), np.int64)]
        columns = [
            np.r_[h[folded], h[single], h[marker], np.zeros(len(known), np.int64)],
            np.r_[np.full(len(folded), FOLDED), np.full(len(single), SINGLE), np.full(len(marker), FOLDED), np.full(len(known), KNOWN)].astype(np.int32),
            np.r_[key_[folded], key_[single], key_[marker], key_known],
            np.r_[start_[folded], start_[single], start_[marker], start_known].astype(np.int32),
        ]
        checks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.r_[check[~busy], check[single]]))
        # Where a known repeat is first met in the task.
        whose = np.r_[np.zeros(len(lengths) - len(known), np.int64), whose]
        where = np.r_[np.zeros(len(lengths) - len(known), np.int32), where]
        return pa.record_batch([*map(pa.array, columns), checks, pa.array(whose), pa.array(where)], names=["anchor", "kind", "key", "start", "checks", "old_key", "old_start"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, held = batch.column(0).to_numpy(), [], 0
            for group in _parts(batch.column(1), window):
                row, base = (np.array(x, np.int64) for x in list(zip(*group, strict=True))[:2])
                words = Words([t for _, _, t in group])
                at, h, check = words.windows(window, anchor)
                if len(at):
                    item = words.text[at]
                    parts.append((h, check, keys[row[item]], base[item] + at - words.first[item]))
                    held += len(at)
                if held >= TOGETHER:
                    yield told(parts)
                    parts, held = [], 0
            if parts:
                yield told(parts)

    found = rows.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(
        emit, "anchor long, kind int, key long, start int, checks array<int>, old_key long, old_start int"
    )
    own = F.when(F.col("kind") == SINGLE, F.xxhash64("anchor", F.get("checks", F.lit(0)))).when(F.col("kind") == KNOWN, F.xxhash64("key", "start"))
    return found.select(F.coalesce(own, "anchor").alias("route"), "kind", "key", "start", "checks", "old_key", "old_start")


class FingerprintIndex:
    """Immutable runs of window fingerprints in a folder, each a table bucketed and sorted by hash.

    Opening a folder again finds the runs that its newest manifest names.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.version, self.runs, self.buckets = 0, [], buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            newest = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None  # a new index
        if newest:
            self.version, self.runs, self.buckets = newest["version"], list(newest["runs"]), newest["buckets"]
        self.pending: str | None = None

    def _name(self, run: str) -> str:
        return f"statloom_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{run}"

    def _table(self, run: str) -> DataFrame:
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{c.split()[0]} {c.split()[1]}" for c in f"{_RUN}, old_key long, old_start int".split(", "))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (route) SORTED BY (route) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            dealt = rows.repartition(self.buckets, "route")
            dealt.write.bucketBy(self.buckets, "route").sortBy("route").option("path", f"{self.path}/{run}").saveAsTable(self._name(run))
        return run

    def _commit(self, runs: list[str]) -> None:
        self.version, self.runs = self.version + 1, runs
        row = self.spark.createDataFrame([(self.version, runs, self.buckets)], "version long, runs array<string>, buckets int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _delete(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        self._remove(f"{self.path}/{run}")

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes a batch's run; gives its repeats (key, start, old_key, old_start), to be read before ``keep``.

        The batch comes after all that is in the index; within it the order is that of keys.
        """
        if len(self.runs) >= FAN_OUT:
            self.compact()
        self.pending = self._write(rows)
        new = self._table(self.pending)
        folded = new.where(F.col("kind") == FOLDED)
        routes = folded.select("route").distinct()
        flagged = folded.withColumn("again", F.count("*").over(Window.partitionBy("route")) > 1)
        unfolded = lambda df, old: df.select(
            "route", "key", "start", F.posexplode("checks").alias("i", "check"), F.lit(old).alias("old")
        ).select(F.xxhash64("route", "check").alias("route"), "check", "key", (F.col("start") + F.col("i")).alias("start"), "old")
        single = lambda run: self._table(run).where(F.col("kind") == SINGLE).select("route", F.get("checks", F.lit(0)).alias("check"), "key", "start")
        history = None
        for old in self.runs:
            theirs = self._table(old).where(F.col("kind") == FOLDED)
            known = theirs.select(F.col("route").alias("_old")).distinct()
            flagged = flagged.join(known, F.col("route") == F.col("_old"), "left").withColumn("again", F.col("again") | F.col("_old").isNotNull()).drop("_old")
            met = unfolded(theirs.join(routes, "route", "left_semi"), True)
            history = met if history is None else history.unionByName(met)
        every = unfolded(flagged.where("again"), False).unionByName(single(self.pending).withColumn("old", F.lit(False)))
        every = every if history is None else every.unionByName(history)
        dealt = every.repartition(self.buckets, "route")
        place = F.struct(~F.col("old"), "key", "start")
        first = F.min(place).over(Window.partitionBy("route", "check"))
        rows = dealt.withColumn("first", F.when(first < place, F.struct(first["key"].alias("key"), first["start"].alias("start")))).where("not old")
        for old in self.runs:
            # Joined by the bucketing column alone, so that no side is shuffled again.
            theirs = single(old).select(F.col("route").alias("_route"), F.col("check").alias("_check"), F.struct("key", "start").alias("_first"))
            same = (F.col("route") == F.col("_route")) & (F.col("check") - F.col("_check") == 0)
            rows = rows.join(theirs, same & F.col("first").isNull(), "left").withColumn("first", F.coalesce("first", "_first")).drop("_route", "_check", "_first")
        found = rows.where("first is not null").select("key", "start", F.col("first.key").alias("old_key"), F.col("first.start").alias("old_start"))
        return found.unionByName(new.where(F.col("kind") == KNOWN).select("key", "start", "old_key", "old_start"))

    def keep(self) -> None:
        """The run that was added joins the history."""
        self._commit([*self.runs, self.pending])
        self.pending = None

    def compact(self) -> None:
        """Merges the newest runs into one that keeps the earliest place of each fingerprint.

        An older run joins in while it has at most ``TIER`` times the rows of those after it, so
        that a long history is not written again for every small batch: there are as many runs
        as sizes, and a fingerprint is written once for each size.
        """
        sizes = [self._table(run).count() for run in self.runs]  # from the files' footers
        first = max(len(self.runs) - 1, 0)
        while first > 0 and sizes[first - 1] <= TIER * sum(sizes[first:]):
            first -= 1
        older, newer = self.runs[:first], self.runs[first:]
        if len(newer) < 2:
            return
        every = self._table(newer[0])
        for run in newer[1:]:
            every = every.unionByName(self._table(run))
        least = every.where(F.col("kind") != KNOWN).groupBy("route", "kind", "checks").agg(F.min(F.struct("key", "start")).alias("first"))
        none = F.lit(None)
        merged = self._write(least.select("route", "kind", "first.key", "first.start", "checks", none.cast("long").alias("old_key"), none.cast("int").alias("old_start")))
        self._commit([*older, merged])
        for run in newer:
            self._delete(run)

    def forget(self) -> None:
        """Drops a run that was not kept, for instance of a batch that failed."""
        if self.pending:
            self._delete(self.pending)
            self.pending = None

    def drop(self) -> None:
        self.forget()
        for run in self.runs:
            self._delete(run)
        self._remove(self.path)
        self.runs = []

    # Digests of whole texts, for exact copies.

    def copies_of(self, digests: DataFrame) -> DataFrame:
        """(key, copies) of the digests of this key (key, digest) that the history or a smaller key has too, as a staged table."""
        first = digests.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        try:
            seen = self.spark.read.schema("digest string").parquet(f"{self.path}/digests").distinct().withColumn("seen", F.lit(True))
            seen.isEmpty()
            first = first.join(seen, "digest", "left")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            first = first.withColumn("seen", F.lit(None).cast("boolean"))
        first = first.where("first < last or seen").select("digest", F.when(F.col("seen"), F.lit(-(1 << 63))).otherwise(F.col("first")).alias("first"))
        later = digests.join(stage(first, "first"), "digest").where("key > first")  # a plain table, so that a hot digest can be split
        return stage(later.groupBy("key").agg(F.collect_set("digest").alias("copies")), "copies")

    def keep_digests(self, digests: DataFrame) -> None:
        digests.select("digest").distinct().write.mode("append").parquet(f"{self.path}/digests")


def repeats(docs: DataFrame, index: FingerprintIndex, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Adds the documents to the index; gives (key, found: start, old_key, old_start) of their repeats, and (key, copies)."""
    spark, rows = docs.sparkSession, keyed(docs)
    digests = stage(rows.select("key", F.md5("text").alias("digest")), "digests")
    copies = index.copies_of(digests)
    shares = [i / batches for i in range(1, batches)]
    cuts = digests.agg(F.percentile_approx("key", shares)).first()[0] or [] if shares else []
    edges = [None, *sorted(set(cuts)), None]
    out = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            part = F.lit(True) if low is None else F.col("key") > low
            part = part if high is None else part & (F.col("key") <= high)
            batch = rows.where(part).join(copies.where(part).hint("merge"), "key", "left")
            batch = batch.where(F.coalesce(~F.array_contains("copies", F.md5("text")), F.lit(True)))
            found = index.add(window_rows(batch, window, anchor))
            with shuffles_freed(spark):
                found.groupBy("key").agg(F.collect_list(F.struct("start", "old_key", "old_start")).alias("found")).write.mode("append").parquet(out)
            index.keep()
        index.keep_digests(digests)
    finally:
        index.forget()
    return spark.read.schema("key long, found array<struct<start:int,old_key:long,old_start:int>>").parquet(out), copies


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    space = _IS_SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
    return edges[0::2], edges[1::2]


class Spaced:
    """A text's words, joined by one space."""

    def __init__(self, text: bytes):
        pieces = (b" ".join(p.split()) for p in pieces_of(text, GROUP))
        self.text = b" ".join(p for p in pieces if p)
        self.n = self.text.count(b" ") + 1 if self.text else 0
        self._gaps = None

    def said(self, first: int, upto: int) -> bytes:
        """The words of these numbers."""
        if self._gaps is None:
            self._gaps = np.r_[-1, np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32), len(self.text)]
        return self.text[self._gaps[first] + 1 : self._gaps[upto]]

    def gone(self, checks: list | None, whole: bool, window: int) -> np.ndarray:
        """Which words go: all of an exact copy, else those of stretches whose digest is theirs."""
        from xxhash import xxh3_128_digest

        if whole:
            return np.full(self.n, self.n >= window)
        gone = np.zeros(self.n, bool)
        for x in checks or []:
            start, upto = x["start"], x["start"] + x["words"]
            if upto <= self.n and xxh3_128_digest(self.said(start, upto)) == x["digest"]:
                gone[start:upto] = True
        return gone

    def kept(self, gone: np.ndarray) -> Iterator[bytes]:
        """The stretches of words that stay."""
        if not gone.any():
            yield from [self.text] if self.n else []
        elif not gone.all():
            for a, b in zip(*staying(gone), strict=True):
                yield self.said(a, b)


def staying(gone: np.ndarray) -> tuple[list[int], list[int]]:
    """Where stretches of words that stay begin and end."""
    edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    return edge[0::2].tolist(), edge[1::2].tolist()


def checks_of(column: pa.Array) -> Iterator[list[dict]]:
    """The checks of every row, none where the list is null; many at once, which is quicker than row by row."""
    inner = column.flatten()
    every = [{"start": a, "words": n, "digest": d} for a, n, d in zip(*(inner.field(i).to_pylist() for i in range(3)), strict=True)]
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    yield from (every[a:b] for a, b in zip([0, *ends], ends, strict=False))


def stretches_of(found: DataFrame, window: int) -> DataFrame:
    """(key, start, words, old_key, old_start): repeats that lie side by side here and there, as one."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            inner = lists.flatten()
            key = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            start, old_key, old_start = (inner.field(i).to_numpy().astype(np.int64) for i in range(3))
            order = np.lexsort((start, old_start - start, old_key, key))
            key, start, old_key, old_start = key[order], start[order], old_key[order], old_start[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (old_key[1:] != old_key[:-1]) | (start[1:] != start[:-1] + 1) | (old_start[1:] != old_start[:-1] + 1)
            first = np.flatnonzero(new)
            words = (np.diff(np.r_[first, len(key)]) + window - 1).astype(np.int32)
            columns = (key[first], start[first].astype(np.int32), words, old_key[first], old_start[first].astype(np.int32))
            yield pa.record_batch([pa.array(x) for x in columns], names=["key", "start", "words", "old_key", "old_start"])

    return found.mapInArrow(joined, "key long, start int, words int, old_key long, old_start int").distinct()


def verified(stretches: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, checks: start, words, digests): each stretch with the digests of the earlier words it repeats.

    The words are those of the documents given, which must hold the history too; of a key with
    several rows each gives a digest.
    """
    from xxhash import xxh3_128_digest

    asked = stretches.select("old_key", "old_start", "words").distinct()
    asked = stage(asked.groupBy("old_key").agg(F.collect_list(F.struct("old_start", "words")).alias("asked")), "asked")
    rows = keyed(docs).join(asked.hint("merge"), F.col("key") == F.col("old_key")).select("old_key", F.col("text").cast("binary").alias("text"), "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, asked in zip(*[batch.column(i) for i in range(3)], strict=True):
                text = Spaced(text.as_py())
                for x in asked.as_py():
                    start, upto = x["old_start"], x["old_start"] + x["words"]
                    if upto <= text.n:
                        out.append((key.as_py(), start, x["words"], xxh3_128_digest(text.said(start, upto))))
            key, start, words, digest = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(words, pa.int32()), pa.array(digest, pa.binary())], names=["old_key", "old_start", "words", "digest"])

    digests = rows.mapInArrow(read, "old_key long, old_start int, words int, digest binary").distinct()
    told = stretches.join(stage(digests, "digests").hint("merge"), ["old_key", "old_start", "words"])
    return told.groupBy("key").agg(F.collect_set(F.struct("start", "words", "digest")).alias("checks"))


def removed_words(text: bytes, checks: list | None, whole: bool, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and which go."""
    return *spans(text), Spaced(text).gone(checks, whole, window)


def kept_stretches(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The stretches of the text that stay, as they were."""
    return [text[starts[a] : ends[b - 1]] for a, b in zip(*staying(gone), strict=True)]


def _with_repeats(docs: DataFrame, window: int, anchor: int, batches: int, index: str | None, history: DataFrame | None) -> DataFrame:
    """row (all columns), text as bytes, checks and whole (an exact copy) of every row."""
    opened = FingerprintIndex(docs.sparkSession, index or f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}")
    try:
        found, copies = repeats(docs, opened, window, anchor, batches)
    finally:
        if index is None:
            opened.drop()
    every = docs.select("doc_id", "text")
    if history is not None:
        every = history.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text").unionByName(every)
    checks = stage(verified(stage(stretches_of(found, window), "stretches"), every), "checks")
    named = docs.select(F.struct("*").alias("row"), key_of().alias("key"), whole_text().alias("text"))
    joined = named.join(checks.hint("merge"), "key", "left").join(copies.hint("merge"), "key", "left")
    whole = F.coalesce(F.array_contains("copies", F.md5("text")), F.lit(False))
    return joined.select("row", F.col("text").cast("binary").alias("text"), "checks", whole.alias("whole"))


def removal_digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, index: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; see ``deduplicated`` for index and history."""
    rows = _with_repeats(docs.select("doc_id", "text"), window, anchor, batches, index, history).select("row.doc_id", "text", "checks", "whole")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, checks, whole in zip(batch.column(1), checks_of(batch.column(2)), batch.column(3), strict=True):
                text = Spaced(text.as_py())
                gone = text.gone(checks, whole.as_py(), window)
                sha, between = hashlib.sha256(), b""
                for kept in text.kept(gone):
                    sha.update(between)
                    sha.update(kept)
                    between = b" "
                out.append((text.n, int(gone.sum()), sha.hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, index: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """The documents with repeated words removed from text, and n_chars of what is left; other columns as they are.

    With ``index``, a folder, the documents come after all that it holds and are added to it;
    ``history`` gives the documents (doc_id, text) that were added before, whose doc_ids differ
    from these and whose words the repeats are verified against.  Without, they stand alone.
    """
    rows = _with_repeats(docs, window, anchor, batches, index, history)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, checks, whole in zip(batch.column(1), checks_of(batch.column(2)), batch.column(3), strict=True):
                text = text.as_py()
                starts, ends, gone = removed_words(text, checks, whole.as_py(), window)
                texts.append(b" ".join(kept_stretches(text, starts, ends, gone)) if gone.any() else text)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["row", "text"])

    out = rows.select("row", "text").schema
    rows = rows.mapInArrow(rewrite, out).select("row", F.col("text").cast("string").alias("text"))
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(new.alias("row")).select("row.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``deduplicated`` of documents that stand alone."""
    return deduplicated(docs)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM repeated, (SELECT unnest(range(0, 20)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
