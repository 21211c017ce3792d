"""What the operators share: tables, words, and the folder for staged tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these six (Java regex classes).
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: A table is broadcast only when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 4096

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(table.select(*columns) if columns else table)


def dealt(table: DataFrame) -> DataFrame:
    """The table, dealt to all cores where its files make fewer parts than these; a table of more parts is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces_of(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut before white space so that no word is cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        upto = gap.start() if gap else len(text)
        yield text[at:upto]
        at = upto


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A local session without one (tests) gets a temporary folder; a cluster must name its own.
    """
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))
        at = context.getCheckpointDir()
    return at


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside drop their shuffle files as they end (for tables written once)."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are ordered in one task, more or less.
GROUP_ROWS = 1 << 18


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``sub``: 0, but a number from 0 where more than ``GROUP_ROWS`` rows share the keys, who are dealt evenly.

    ``rows`` is a staged table with ``place``, a number of each row's own: the keys' counts say
    which are hot, at most one for every ``GROUP_ROWS`` rows.
    """
    most = GROUP_ROWS
    hot = rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > most)
    hot = hot.select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("held") / most).alias("parts"))
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if not found:
        return rows.withColumn("sub", F.lit(0).cast("long"))
    same = None
    for k in keys:
        own = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = own if same is None else same & own
    joined = rows.join(F.broadcast(hot) if found <= BROADCAST_ROWS else hot, same, "left")
    sub = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(0).cast("long")
    return joined.select(*rows.columns, sub.alias("sub"))
