"""Records with child files: search, pages, detail, selection, order of children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.selection import ranked


def search(records: DataFrame, predicates: list[Column]) -> DataFrame:
    return records.where(reduce(lambda a, b: a & b, predicates, F.lit(True)))


def child_counts(records: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n_children", few: bool = False) -> DataFrame:
    """LEFT JOIN with children aggregated first, so that only one row for each key is shuffled. few: records are one page, whose
    keys are sent to the children, so that only these are counted."""
    if few:
        children = children.join(F.broadcast(records.select(F.col(key).alias(child_key))), child_key, "left_semi")
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return records.join(F.broadcast(counts) if few else counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1. order must end in a key, or pages may overlap."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.ceil(total / size).cast("long").alias("pages"))


def selection_report(records: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """For each chosen (role, key): whether it is there, and whether both roles have it."""
    there = records.select(key).withColumn("there", F.lit(True))
    roles = chosen.groupBy(key).agg(F.countDistinct("role").alias("roles"))
    out = chosen.join(roles, key).join(there, key, "left")
    return out.select("role", key, F.coalesce("there", F.lit(False)).alias("found"), (F.col("roles") > 1).alias("overlaps"))


def first_children(children: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first children of each record. Spark keeps no more than `most` rows of a key in a task before they are dealt by key."""
    placed = children.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    return placed.where(F.col("place") <= most)


def scoped_items(items: DataFrame, contexts: DataFrame, item: str, context: str, most: int) -> DataFrame:
    """(context, item, place): items (item, scopes) that share a scope with a context (context, scopes), or are global; the first ones by
    item. Joined by scope, and no more than `most` of a context leave a task."""
    scope = lambda rows, key, scopes: rows.select(key, F.explode(F.array_compact(scopes)).alias("scope")).distinct()
    both = scope(items, item, F.col("scopes")).join(scope(contexts, context, F.concat("scopes", F.array(F.lit("global")))), "scope").select(context, item).distinct()
    return first_children(both, context, [F.col(item)], most)


def lookups(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys with their record's columns and a status: 200 where it is, 404 where it isn't."""
    known = records.join(wanted.select(key), key, "left_semi").withColumn("status", F.lit(200))  # Spark broadcasts what is small
    return wanted.select(key).join(known, key, "left").withColumn("status", F.coalesce("status", F.lit(404)))


def unique_names(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """rows with `unique_name`: the first of equal names keeps it, later ones get a number before their ending."""
    n = F.col("rank_")
    numbered = F.regexp_replace(F.col(name), "(\\.[A-Za-z0-9]{1,5})?$", F.concat(F.lit("_"), n, F.lit("$1")))
    return ranked(rows, [name], order, "rank_").withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.regexp_replace(numbered, "(_[0-9]+)(\\.[A-Za-z0-9]{1,5})?\\1$", "$1$2"))).drop("rank_")
