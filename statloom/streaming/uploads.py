"""Observations that arrive as files and replace those of their indicators.

An extension: batches are upserted as they come, by the same rules as a partial refresh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.load import first_of_each

OBSERVATIONS = "indicator_id int, district_id string, year int, period string, period_no int, value double, ord long"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of observation files (Parquet) dropped into a folder."""
    return spark.readStream.schema(OBSERVATIONS).parquet(folder)


def upsert_stream(arriving: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch replaces the observations of the indicators it holds; ``target`` has a partition for each.

    Only the partitions of these indicators are written, nothing old is read.  A batch that is
    run again writes the same partitions again.
    """

    def load(batch: DataFrame, number: int) -> None:
        new = first_of_each(batch).drop("ord").hint("rebalance", "indicator_id")  # a hot indicator is written by several tasks
        new.write.partitionBy("indicator_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)

    writer = arriving.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by type and window; rows later than the watermark are passed over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
