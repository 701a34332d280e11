"""Profiles of tables in long form (table_id, row_no, col_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.budgets import running_total
from evidra.operators.grids import spread_places


def field_stats(values: DataFrame, field: str, value: str) -> DataFrame:
    """Filled and distinct values of each field, and the range of their numbers."""
    text = F.trim(F.col(value))
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")
    full = values.where(text != "").select(field, text.alias("v"), number.alias("n"))
    return full.groupBy(field).agg(F.count(F.lit(1)).alias("non_empty"), F.countDistinct("v").alias("distinct_values"), F.min("n").alias("least"), F.max("n").alias("most"))


def top_categories(rows: DataFrame, category: str, most: int = 30) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category).limit(most)


def spread(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """At most k rows of each group, evenly spread over the order of a number: places round(i (n - 1) / (k - 1)), halves to even. Rows of
    a large group are numbered in slots, so no task sees it whole."""
    at = running_total(rows.withColumn("one", F.lit(1)), group, order, [], "one", "at").withColumn("at", F.col("at") - 1).drop("one")
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return at.join(n, group).where(F.array_contains(spread_places(F.col("n").cast("int"), F.lit(k)), F.col("at").cast("int"))).drop("n")


def reassemble(cells: DataFrame, row_key: list[str], order: str, value: str, mark: str = " | ") -> DataFrame:
    """The cells of a row in the order of their columns, joined."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), mark)
    return cells.groupBy(*row_key).agg(row.alias("row_text"))
