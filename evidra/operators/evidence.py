"""Evidence items: content-addressed identity, validation, dependencies, facts and conflicts, selection under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.sources.staging import staged


def item_id(*parts: Column) -> Column:
    """sha256 of the parts, joined by a character that texts don't hold."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def violations(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item, problem) for items (item, level) and links (item, source): a B item without a validated A source, a source that
    isn't there, an A item that has a source."""
    known = items.select(F.col("item").alias("source"), F.col("level").alias("source_level"))
    held = links.join(known, "source", "left").groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("source_level").isNull()).alias("lost"), F.max(F.coalesce(F.col("source_level") == "A", F.lit(False))).alias("direct")
    )
    both = items.join(held, "item", "left")
    problem = (
        F.when((F.col("level") == "B") & ~F.coalesce("direct", F.lit(False)), "no_direct_source").when(F.coalesce("lost", F.lit(False)), "missing_source").when((F.col("level") == "A") & (F.coalesce("n", F.lit(0)) > 0), "direct_with_source")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("item", "problem")


def unmatched_hashes(items: DataFrame, links: DataFrame, item: str, digest: str) -> DataFrame:
    """(item, n_sources, digest) of items (item, digest) that have sources (item, digest), none of which has the item's digest."""
    own = items.select(item, F.col(digest).alias("own"))
    held = links.join(own, item).groupBy(item, "own").agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.bool_or(F.col(digest) == F.col("own")), F.lit(False)).alias("yes"))
    return held.where("not yes").select(item, "n_sources", F.col("own").alias(digest))


def conflicts(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each fact key, whether its values agree; of agreeing ones the smallest stays."""
    out = facts.groupBy(*key).agg(F.countDistinct(value).alias("values_seen"), F.min(value).alias("first_value"), F.count(F.lit(1)).alias("candidates"))
    return out.withColumn("conflict", F.col("values_seen") > 1).withColumn("kept_value", F.when(~F.col("conflict"), F.col("first_value"))).drop("first_value")


def closure(start: DataFrame, links: DataFrame) -> DataFrame:
    """All items that can be reached from start (item) over links (item, source), itself included. Every round is written to the shared
    folder, so lineage stays short and nothing is held in memory; it ends when a round finds nothing new, however deep the links are. What
    a round found is written before it is compared with what was seen: few such items are broadcast, and what was seen isn't shuffled.
    Links may repeat."""
    parts = [staged(start.select("item").distinct(), "reached")]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        found = staged(parts[-1].join(links, "item").select(F.col("source").alias("item")).distinct(), "found")
        fresh = staged(found.join(seen.join(found, "item", "left_semi"), "item", "left_anti"), "reached")
        if fresh.isEmpty():
            return seen
        parts.append(fresh)


def retention(before: DataFrame, after: DataFrame, group: str, key: str) -> DataFrame:
    """Share of the mandatory items that are left, to six places; null where there are none."""
    left = after.select(key).withColumn("left", F.lit(1))
    out = before.join(left, key, "left").groupBy(group)
    n, m = F.count_if("mandatory"), F.count_if(F.col("mandatory") & F.col("left").isNotNull())
    return out.agg(n.alias("mandatory_items"), m.alias("retained"), F.bround(m / F.when(n > 0, n), 6).alias("retention"))


def missing_mandatory(before: DataFrame, after: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key): mandatory items that are no longer there. A row for each, as a group may miss any number."""
    return before.where("mandatory").select(group, key).distinct().join(after.select(key), key, "left_anti").select(group, key)


def retention_status(before: DataFrame, after: DataFrame, group: str, key: str) -> DataFrame:
    """(group, total, retained, missing, rate, status): of different mandatory items; no rate and not_applicable where there are none."""
    held = after.select(key).distinct().withColumn("left_", F.lit(1))
    own = before.groupBy(group, key).agg(F.bool_or("mandatory").alias("must")).join(held, key, "left")
    n, m = F.count_if("must"), F.count_if(F.col("must") & F.col("left_").isNotNull())
    rate = F.bround(m / F.when(n > 0, n), 6)
    return own.groupBy(group).agg(n.alias("total"), m.alias("retained"), (n - m).alias("missing"), rate.alias("rate"), F.when(n > 0, "measured").otherwise("not_applicable").alias("status"))
