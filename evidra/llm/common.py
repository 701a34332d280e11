"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.staging import shared_dir, staged  # noqa: F401  used by the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


#: Bytes that Spark puts into one Arrow batch for Python, where the session leaves it to the default of 64 MB.
BATCH_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Makes Spark cut Arrow batches by fewer bytes, so that rows with long texts don't fill a worker together."""
    if spark.conf.get(_BATCH_CONF, None) in (None, f"{64 << 20}b"):
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def join_counted(rows: DataFrame, table: DataFrame, key: str, counted: str) -> DataFrame:
    """rows left joined with table (one row for each key), where table's column `counted` tells how many rows have the key. Keys
    with a large share of the rows come as a broadcast of at most 4 keys for each partition, so they gather nowhere."""
    often = table.agg(F.sum(counted)).first()[0] or 0
    often = max(1000, -(-often // (4 * n_partitions(rows.sparkSession))))
    hot, rest = table.filter(F.col(counted) >= often).drop(counted), table.filter(F.col(counted) < often).drop(counted)
    if hot.isEmpty():
        return rows.join(rest, key, "left")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Where all characters are ASCII, lower() does the same and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about most_bytes at most (or are one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(name)).to_pylist()])
        ends, start, total = [], 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most_bytes:
                ends.append(i)
                total = 0
            total += int(size)
        for end in [*ends, batch.num_rows]:
            yield batch.slice(start, end - start)
            start = end


def ids_in_hash_order(rows: DataFrame, id_col: str, most: int) -> list[int]:
    """At most `most` ids, those whose hash is smallest: a bounded sample that doesn't depend on row order."""
    found = rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most).collect()
    return [r[0] for r in found]


def rows_with_ids(docs: DataFrame, id_col: str, ids: list[int]) -> DataFrame:
    """The rows of docs with these (boundedly many) ids."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} long")
    return docs.join(F.broadcast(wanted), id_col, "left_semi")


def release_memory() -> None:
    """Gives freed memory back to the system: a worker or driver that lives on would hold its peak."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def training_rows(labels: DataFrame, label: str, fold: int = 2, folds: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled rows outside the held-out fold, one for each id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (bucket_of(F.col(id_col), folds) != fold))
    return rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
