"""The fold of an event log over a stream (an extension: batches of events update the latest state of each run)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", group: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; on a stream, events later than the watermark are dropped. Batch and stream give the same rows."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def distinct_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Repeated event ids are no-ops."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
