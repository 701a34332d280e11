"""Sinks: event logs in segments, quarantine of damaged lines, publishing once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.budgets import running_total
from evidra.sources import event_log

#: Events and bytes of a segment of a log, and segments that are kept.
SEGMENT_EVENTS, SEGMENT_BYTES, KEPT_SEGMENTS = 100_000, 50 << 20, 12


def segmented(events: DataFrame, order: list[str], most_events: int = SEGMENT_EVENTS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """events with the segment that each belongs to, from 0: a new one begins when the events, or their bytes as JSON lines, would go
    beyond the bounds. Events are numbered over ranges of the order and shifted by the ranges before, so no task sees them all; a segment
    is bounded by whichever of the two counts is further ahead."""
    line = F.to_json(F.struct(*events.columns))
    sized = events.withColumn("g", F.lit(0)).withColumn("one", F.lit(1)).withColumn("bytes", F.octet_length(line) + 1).withColumn("rank", F.unix_micros(F.col(order[0]).cast("timestamp")))
    both = running_total(running_total(sized, "g", "rank", order, "one", "n"), "g", "rank", order, "bytes", "b")
    segment = F.greatest(F.floor((F.col("n") - 1) / most_events), F.floor((F.col("b") - F.col("bytes")) / most_bytes))
    return both.withColumn("segment", segment.cast("int")).drop("g", "one", "bytes", "rank", "n", "b")


def append_events(events: DataFrame, path: str, key: str = "event_id") -> int:
    """Appends those events that the log doesn't have yet, as JSON lines; returns how many. Spark's committer renames finished files into
    place, so a reader sees whole files only, and a repeated call adds nothing."""
    spark = events.sparkSession
    fresh = events.dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.json(path, recursiveFileLookup=True).select(key), key, "left_anti")
    fresh = fresh.select(*events.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path, ignoreNullFields=False)
    return n


def write_segments(events: DataFrame, path: str, kept: int = KEPT_SEGMENTS) -> None:
    """A log by segment (events from `segmented`): the newest ones are kept, older ones are left out."""
    newest = events.agg(F.max("segment").alias("s")).first()["s"]
    if newest is None:
        return
    events.where(F.col("segment") > newest - kept).repartition("segment").write.mode("overwrite").partitionBy("segment").json(path, ignoreNullFields=False)


def quarantine(spark: SparkSession, path: str, aside: str, schema: str) -> tuple[DataFrame, int]:
    """The good events of a log, and how many damaged lines were written aside (with the file that they come from)."""
    good, bad = event_log(spark, path, schema)
    n = bad.count()
    if n:
        bad.write.mode("append").json(aside)
    return good, n


def publish_once(rows: DataFrame, path: str, key: str, digest: str) -> DataFrame:
    """Writes those rows whose key isn't published yet, and tells for every row: published, already (same digest) or conflict."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        rows.write.mode("append").parquet(path)
        return rows.select(key, F.lit("published").alias("state"))
    before = spark.read.parquet(path).select(key, F.col(digest).alias("old"))  # lists the files as they are now
    told = rows.select(key, digest).join(before, key, "left")
    states = told.select(key, F.when(F.col("old").isNull(), "published").when(F.col("old") == F.col(digest), "already").otherwise("conflict").alias("state"))
    rows.join(before.select(key), key, "left_anti").write.mode("append").parquet(path)
    return states


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
