"""Exact nearest-rank percentiles and ranks, where no task holds a group's values.

A percentile is found between two values: a sketch of the group tells a bracket around the wanted rank, one pass counts exactly how
many values lie below and in it, and the next round goes on inside. A bracket that doesn't hold the rank by exact count isn't taken,
so the sketch only saves work. What is left is counted by value and summed in slots of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.budgets import running_sums
from evidra.sources.staging import staged

#: Values that a bracket may hold at the end, cuts of a sketch, rounds at most (each leaves some 1 in 80).
MOST_VALUES, CUTS, ROUNDS = 100_000, 256, 4


def _sketch(c: Column) -> Column:
    return F.percentile_approx(c, [i / CUTS for i in range(1, CUTS)], 10_000)


def nearest_ranks(values: DataFrame, groups: Sequence[str], value: str, points: Sequence[float], most: int = MOST_VALUES, slots: int | None = None) -> DataFrame:
    """(groups, p, found): for each point p in (0, 1] the value whose rank among those that aren't null is ceil(p n). Groups without values
    have no row."""
    keys = list(groups)
    rows = values.select(*keys, F.col(value).alias("v_")).where("v_ is not null")
    wanted = F.inline(F.array(*(F.struct(F.lit(float(p)).alias("p")) for p in points)))
    n = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")), "counts")
    rank = F.greatest(F.ceil(F.round(F.col("p") * F.col("n_"), 6)), F.lit(1)).alias("k_")
    open_ = n.select(*keys, "n_", wanted).select(*keys, "p", rank, F.lit(0).cast("long").alias("below"), F.col("n_").alias("inside"), F.lit(None).cast(rows.schema["v_"].dataType).alias("lo"), F.lit(None).cast(rows.schema["v_"].dataType).alias("hi"))
    for _ in range(ROUNDS):
        large = (F.col("inside") > most) & (F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") < F.col("hi")))
        if open_.where(large).isEmpty():
            break
        within = (F.col("lo").isNull() | (F.col("v_") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v_") <= F.col("hi")))
        sketched = rows.join(open_.where(large), keys).where(within).groupBy(*keys, "p").agg(_sketch(F.col("v_")).alias("cuts"))
        at = F.floor((F.col("k_") - F.col("below")) * CUTS / F.col("inside")).cast("int")
        tried = open_.where(large).join(sketched, [*keys, "p"]).withColumns({"lo_": F.coalesce(F.try_element_at("cuts", F.when(at > 1, at - 1)), "lo"), "hi_": F.coalesce(F.try_element_at("cuts", F.when(at + 2 < CUTS, at + 2)), "hi")})
        tried = staged(tried.drop("cuts"), "tried")
        fits = (F.col("lo_").isNull() | (F.col("v_") >= F.col("lo_"))) & (F.col("hi_").isNull() | (F.col("v_") <= F.col("hi_")))
        counted = rows.join(tried.select(*keys, "p", "lo", "hi", "lo_", "hi_"), keys).where(within).groupBy(*keys, "p").agg(F.count_if(F.col("lo_").isNotNull() & (F.col("v_") < F.col("lo_"))).alias("less"), F.count_if(fits).alias("there"))
        both = tried.join(counted, [*keys, "p"])
        rest = F.col("k_") - F.col("below") - F.col("less")
        sure = (rest >= 1) & (rest <= F.col("there"))
        narrowed = both.select(*keys, "p", "k_", F.when(sure, F.col("below") + F.col("less")).otherwise(F.col("below")).alias("below"), F.when(sure, F.col("there")).otherwise(F.col("inside")).alias("inside"), F.when(sure, F.col("lo_")).otherwise(F.col("lo")).alias("lo"), F.when(sure, F.col("hi_")).otherwise(F.col("hi")).alias("hi"))
        open_ = staged(open_.where(~large).unionByName(narrowed), "brackets")
    held = rows.join(open_, keys).where((F.col("lo").isNull() | (F.col("v_") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v_") <= F.col("hi"))))
    counts = held.groupBy(*keys, "p", "k_", "below", "v_").agg(F.count(F.lit(1)).alias("w_"))
    summed = running_sums(counts, [*keys, "p", "k_", "below"], "v_", ["w_"], slots)
    return summed.where(F.col("below") + F.col("so_far_w_") >= F.col("k_")).groupBy(*keys, "p").agg(F.min("v_").alias("found"))


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with their rank in their group (1, 2, ...), equal ones in any order. Rows are sorted over ranges of group and order, numbered
    within them and shifted by what the ranges before them hold, so a group may lie in many tasks. A group is where its columns are equal,
    nulls included."""
    from functools import reduce

    keys = [f"o_{k}" for k in range(len(order))]
    marked = staged(rows.withColumns(dict(zip(keys, order, strict=True))).withColumn("tie_", F.monotonically_increasing_id()), "marked")
    by = [*groups, *keys, "tie_"]
    sorted_ = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("uid_", F.monotonically_increasing_id())
    sorted_ = staged(sorted_.drop(*keys, "tie_"), "sorted").withColumn("part_", F.shiftright("uid_", 33))
    parts = sorted_.groupBy(*groups, "part_").agg(F.count(F.lit(1)).alias("here_"), F.min("uid_").alias("first_"))
    before = F.coalesce(F.sum("here_").over(Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(parts.select(*(F.col(g).alias(f"g_{g}") for g in groups), F.col("part_").alias("at_"), "first_", before.alias("before_")), "starts")
    same = reduce(lambda a, b: a & b, [sorted_[g].eqNullSafe(starts[f"g_{g}"]) for g in groups], F.col("part_") == F.col("at_"))
    told = sorted_.join(starts, same).withColumn(name, (F.col("uid_") - F.col("first_") + F.col("before_") + 1).cast("long"))
    return told.select(*rows.columns, name)
