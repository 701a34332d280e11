"""Sources: tables, delimited files, office files and archives, pages, event logs with damaged lines, JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, sql: str, options: dict[str, str] | None = None, timeout: int = 20) -> DataFrame:
    """Rows of a SELECT in a database, read by its driver (which must be on the class path) with a time limit in seconds."""
    return spark.read.format("jdbc").options(url=url, query=sql, queryTimeout=str(timeout), **(options or {})).load()


def normalised_rows(rows: DataFrame) -> DataFrame:
    """Columns as an API shows them: times as ISO text, other values as text, nulls as empty; numbers stay numbers, null ones 0."""
    out = []
    for f in rows.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        elif kind in ("integer", "long", "short", "byte"):
            c = F.coalesce(c, F.lit(0)).cast("long")
        elif kind not in ("double", "float", "decimal", "boolean"):
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.alias(f.name))
    return rows.select(*out)


def event_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Events of a JSON-lines log with all its archives, and its damaged lines (file, line), to be written aside."""
    lines = spark.read.text(path, recursiveFileLookup=True).where("trim(value) <> ''").select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    rows = lines.withColumn("x", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("x._corrupt_record").isNotNull()
    return rows.where(~bad).select("x.*").drop("_corrupt_record"), rows.where(bad).select("file", "line")


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one for each file, by the schema; a file that is none gives a row with `damaged`."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    parsed = rows.withColumn("x", F.from_json("raw", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("file", "x.*").withColumn("damaged", F.col("_corrupt").isNotNull()).drop("_corrupt")
