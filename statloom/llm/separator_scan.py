"""Token counts of documents in flat token files without an index, by a separator scan.

A flat file holds token ids one after another, a separator id closing each document.  It is
read as blocks (file, block, data).  Each block is searched for separators at once; what is
kept is the number of ids and the positions found.  Where documents run across blocks, a
prefix scan over the block summaries gives each block its first id's place in the file, the
number of documents closed before it and the place where the document open at its start
began.  The scan has two levels (segments of blocks, then blocks), so no task orders a file.

Defined results: a document without ids counts 0; ids after the last separator are a
document that is not terminated; blocks without separators and empty blocks are passed
over; no blocks give no rows.  Ids cut by the end of a block are refused.  Null texts are
empty, rows that repeat are counted each, doc_id may have any type and other columns play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import stage
from .tokenizing import WordTokenizer

#: Ids are written in 16 bits where the vocabulary leaves the last number free, else in 32.
NARROW = (1 << 16) - 1
BLOCK_IDS = 1 << 16
SEGMENT = 1024


def id_width(path: str | None = None) -> int:
    """Bytes of an id in the flat files; the largest number of that width is the separator.

    No id of the vocabulary is that number, so no text can hold it.
    """
    return 2 if WordTokenizer(path).ids <= NARROW else 4


def separator_of(width: int) -> int:
    return (1 << 8 * width) - 1


def flat_blocks(docs: DataFrame, block_ids: int = BLOCK_IDS, path: str | None = None, width: int = 2) -> DataFrame:
    """The texts as flat token files of ids of ``width`` bytes, one file for each task.

    Columns file, block and data, and the manifest that names what the file itself doesn't:
    doc_ids, the documents that end in the block.  Blocks are cut by size alone.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType
    size, end = width * block_ids, separator_of(width).to_bytes(width, "little")
    arrow = to_arrow_type(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, file = WordTokenizer.of_worker(path), f"part-{TaskContext.get().partitionId():06d}"
        held, ended, block = bytearray(), [], 0  # ended: (place of the separator, doc_id)

        def full(data: bytes, at: int, names: list) -> pa.RecordBatch:
            columns = [pa.array([file]), pa.array([at], pa.int64()), pa.array([bytes(data)], pa.binary()), pa.array([names], pa.list_(arrow))]
            return pa.record_batch(columns, names=["file", "block", "data", "doc_ids"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py())
                held += ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                held += end
                ended.append((len(held), name))
                while len(held) >= size:
                    yield full(held[:size], block, [x for at, x in ended if at <= size])
                    ended = [(at - size, x) for at, x in ended if at > size]
                    del held[:size]
                    block += 1
        if held:
            yield full(held, block, [x for _, x in ended])

    return rows.mapInArrow(write, f"file string, block long, data binary, doc_ids array<{kind.simpleString()}>")


def blocks_of_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(file, block, data) of flat files in a folder; a file is read whole, so up to 2 GB each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                view = content.as_buffer()
                for block, at in enumerate(range(0, view.size, block_bytes)):
                    data = view.slice(at, min(block_bytes, view.size - at)).to_pybytes()
                    yield pa.record_batch([pa.array([file.as_py()]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return files.mapInArrow(cut, "file string, block long, data binary")


def find_separators(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file, block, ids (how many) and found (positions of separators) of each block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for x in batch.column(2):
                data = np.frombuffer(x.as_buffer() if x.is_valid else b"", f"<u{width}")
                ids.append(len(data))
                found.append(np.flatnonzero(data == separator).astype(np.int32))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["file", "block", "ids", "found"],
            )

    return blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, ids long, found array<int>")


def stitched(found: DataFrame) -> DataFrame:
    """The blocks of a staged ``find_separators`` with begins, closed and opened.

    begins: place of the block's first id in its file; closed: documents closed before the
    block; opened: place where the document open at the block's start began.
    """
    summary = found.select(
        "file", "block", "ids", F.floor(F.col("block") / SEGMENT).alias("segment"),
        F.size("found").cast("long").alias("closes"),
        (F.try_element_at("found", F.lit(-1)) + 1).cast("long").alias("after"),  # where the last separator leaves off
    )
    inside = Window.partitionBy("file", "segment").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = summary.withColumn("begins", F.coalesce(F.sum("ids").over(earlier), zero)).withColumn(
        "closed", F.coalesce(F.sum("closes").over(earlier), zero)
    )
    local = local.withColumn("opened", F.max(F.col("begins") + F.col("after")).over(earlier))
    segments = local.groupBy("file", "segment").agg(
        F.sum("ids").alias("ids"), F.sum("closes").alias("closes"), F.max(F.col("begins") + F.col("after")).alias("after")
    )
    over_segments = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.select(
        "file", "segment", "after",
        F.coalesce(F.sum("ids").over(over_segments), zero).alias("base"),
        F.coalesce(F.sum("closes").over(over_segments), zero).alias("base_closed"),
    ).withColumn("base_opened", F.coalesce(F.max(F.col("base") + F.col("after")).over(over_segments), zero))
    return local.join(bases.drop("after"), ["file", "segment"]).select(
        "file",
        "block",
        "ids",
        (F.col("base") + F.col("begins")).alias("begins"),
        (F.col("base_closed") + F.col("closed")).alias("closed"),
        F.greatest("base_opened", F.coalesce(F.col("base") + F.col("opened"), zero)).alias("opened"),
    )


def documents_in(found: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated (and doc_id by a manifest) of every document.

    ``found`` is a staged ``find_separators``; ``manifest`` has file, block and doc_ids.
    """
    placed = stitched(found).join(found.select("file", "block", "found"), ["file", "block"])
    if manifest is not None:
        placed = placed.join(manifest.select("file", "block", "doc_ids"), ["file", "block"])
    start = lambda i: F.when(i == 0, F.col("opened")).otherwise(F.col("begins") + F.get("found", i - 1) + 1)
    named = lambda i: [F.get("doc_ids", i).alias("doc_id")] if manifest is not None else []
    each = F.transform(
        "found",
        lambda at, i: F.struct(
            (F.col("closed") + i).alias("ordinal"),
            start(i).alias("start"),
            (F.col("begins") + at - start(i)).alias("n_tokens"),
            F.lit(True).alias("terminated"),
            *named(i),
        ),
    )
    closed = placed.select("file", F.inline(each))
    last = placed.select("file", "ids", "begins", (F.col("closed") + F.size("found")).alias("ordinal"),
                         F.greatest("opened", F.coalesce(F.col("begins") + F.try_element_at("found", F.lit(-1)) + 1, F.lit(0))).alias("start"))
    rest = last.groupBy("file").agg(F.max("ordinal").alias("ordinal"), F.max("start").alias("start"), F.max(F.col("begins") + F.col("ids")).alias("upto"))
    rest = rest.where("upto > start").select("file", "ordinal", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(rest, allowMissingColumns=True)


def token_counts(docs: DataFrame, block_ids: int = BLOCK_IDS, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document, with its file, ordinal and start in the flat files."""
    width = id_width(path)
    blocks = stage(flat_blocks(docs, block_ids, path, width), "tokens")
    found = stage(find_separators(blocks, separator_of(width), width), "separators")
    return documents_in(found, blocks).select("doc_id", "n_tokens", "file", "ordinal", "start")
