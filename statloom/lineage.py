"""Cutting the lineage of a DataFrame that many later steps look at, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A local session without such a folder gets a temporary one; a cluster must name a shared one.
    """
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="statloom-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever store it is in; one that is not there is left alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, label: str = "rows") -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: computed once, later plans see columns and sizes."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut."""
    return staged(df, "cut")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if there are at most ``BROADCAST_ROWS``; else Catalyst chooses."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def every_pair(left: DataFrame, right: DataFrame, parts: int = 64) -> DataFrame:
    """Each row of the left with each of the right, where that is what is wanted.

    A right side of counted, few rows is broadcast; a larger one is dealt to parts, which the left
    side's rows meet by equality, one copy for each part.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.crossJoin(F.broadcast(right))
    copies = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
    return copies.join(dealt, "_part").drop("_part")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """The rows with their place (from 1) in an order, in ranges of it: ranges are counted, then rows within each."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(bases, "_part").select(*df.columns, (F.col("_base") + within).alias(name))
