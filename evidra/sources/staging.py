"""Written tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a temporary folder of its
    own; on a cluster that would be another disk for each machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='evidra-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/evidra-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, and fixes what tasks numbered."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_in_blocks(df: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """Like staged, in row groups of about so many bytes (as written into memory). A file is read by no more tasks than it has row groups,
    so small ones spread a table that few tasks wrote over many, without a shuffle."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("parquet.block.size", block_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
