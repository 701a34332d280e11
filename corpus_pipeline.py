"""A training-data pipeline over `documents`: toxicity, exact copies, near copies, secrets, packing.

Each stage reads what the one before it kept, as Parquet. The first four return the columns of documents: toxic documents,
all but one of equal texts, and all but one of each group of near copies go; secrets are replaced by the name of their kind.
The last one returns a batch plan, a row for each remaining document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from evidra.llm.common import documents, labels, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]
#: The toxicity score can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
