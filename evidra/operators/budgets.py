"""Sums, ranks and last values over ordered rows, and selections under a budget. Rows of a group are dealt to slots by where they stand in the order, so no task
sees a whole group: a slot is summed within itself and shifted by the slots before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slot should hold, slots at most, and cuts that are compared with a row at once.
SLOT_ROWS, MOST_SLOTS, CUTS = 100_000, 1024, 32


def in_slots(rows: DataFrame, rank: str, slots: int | None = None) -> DataFrame:
    """rows with a slot: where the number `rank` stands among its quantiles over all rows; as many slots as the rows need, if none are
    given. The cuts only deal out work: equal ranks share a slot, and any cuts give the same results."""
    slots = slots or max(1, min(MOST_SLOTS, -(-rows.count() // SLOT_ROWS)))
    cuts = []
    if slots > 1:
        points = ", ".join(f"{i / slots!r}D" for i in range(1, slots))
        told = F.expr(f"percentile_approx(`{rank}`, array({points}), 10000)")
        cuts = sorted(set(rows.agg(told.alias("c")).first()["c"] or []))
    if not cuts:
        return rows.withColumn("slot", F.when(F.col(rank).isNull(), -1).otherwise(0).cast("int"))
    # in two steps, so that a row is compared with some of many cuts
    blocks = [cuts[i : i + CUTS] for i in range(0, len(cuts), CUTS)]
    passed = lambda of: F.size(F.filter(of, lambda c: c <= F.col(rank)))
    block = F.greatest(passed(F.array(*(F.lit(x[0]) for x in blocks))), F.lit(1))
    slot = (block - 1) * CUTS + passed(F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in blocks)), block))
    return rows.withColumn("slot", F.when(F.col(rank).isNull(), -1).otherwise(slot).cast("int"))


def running_sums(rows: DataFrame, groups: Sequence[str], rank: str, sums: Sequence[str], slots: int | None = None) -> DataFrame:
    """rows with the sum of each named column over its groups up to the row, in the order of the number `rank`, which no two rows of a
    group share; `so_far_` and the column's name."""
    dealt = in_slots(rows, rank, slots)
    of_slot = dealt.groupBy(*groups, "slot").agg(*(F.sum(c).alias(f"s_{c}") for c in sums))  # groups * slots rows
    before = Window.partitionBy(*groups).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = of_slot.select(*groups, "slot", *(F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"ahead_{c}") for c in sums))
    within = Window.partitionBy(*groups, "slot").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"so_far_{c}": F.sum(c).over(within) for c in sums}).join(ahead, [*groups, "slot"])
    return own.withColumns({f"so_far_{c}": F.col(f"so_far_{c}") + F.col(f"ahead_{c}") for c in sums}).drop("slot", *(f"ahead_{c}" for c in sums))


def water_levels(children: DataFrame, parent: Sequence[str], size: str, floor: str, budgets: DataFrame, slots: int | None = None) -> DataFrame:
    """(parent, budget, level): the largest whole number up to which all children of a parent can be filled within its budget, where a
    child takes least(size, greatest(floor, level)). null: the floors alone exceed the budget. What the children would take at a
    level is a broken line that turns at their floors and sizes, so it is summed over these turns: a row for each different one."""
    turns = children.select(*parent, F.inline(F.array(F.struct(F.col(floor).alias("at"), F.lit(1).cast("long").alias("slope")), F.struct(F.col(size).alias("at"), F.lit(-1).cast("long").alias("slope")))))
    turns = turns.groupBy(*parent, "at").agg(F.sum("slope").alias("slope")).withColumn("moment", F.col("slope") * F.col("at"))
    least = children.groupBy(*parent).agg(F.sum(floor).alias("least"))
    line = running_sums(turns, parent, "at", ["slope", "moment"], slots).join(least, list(parent)).join(budgets, list(parent))
    line = line.withColumn("taken", F.col("least") + F.col("so_far_slope") * F.col("at") - F.col("so_far_moment")).where("taken <= budget")
    last = line.groupBy(*parent).agg(F.max(F.struct("at", F.col("so_far_slope").alias("slope"), "taken")).alias("x"))
    level = F.col("x.at") + F.when(F.col("x.slope") > 0, F.floor((F.col("budget") - F.col("x.taken")) / F.col("x.slope"))).otherwise(0)
    return budgets.join(last, list(parent), "left").select(*parent, "budget", level.cast("long").alias("level"))


def running_total(rows: DataFrame, group: str, rank: str, ties: Sequence[str], size: str, name: str = "running", slots: int | None = None) -> DataFrame:
    """rows with the sum of `size` over the group up to each row, in the order of the number `rank` (ascending), then `ties`."""
    dealt = in_slots(rows, rank, slots)
    sums = dealt.groupBy(group, "slot").agg(F.sum(size).alias("s"))  # groups * slots rows
    before = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(group, "slot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(group, "slot").orderBy(F.col(rank), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(name, F.sum(size).over(within)).join(ahead, [group, "slot"]).withColumn(name, (F.col(name) + F.col("ahead")).cast("long")).drop("slot", "ahead")


def carried(rows: DataFrame, group: str, rank: str, ties: Sequence[str], value: Column, name: str, slots: int | None = None, same_rank: bool = False) -> DataFrame:
    """rows with the last `value` that isn't null up to each row of its group; same_rank: the largest value of those with a rank up to the
    row's, later ties included."""
    dealt = in_slots(rows.withColumn("v", value), rank, slots)
    order = F.struct(rank, *ties)
    last = F.max("v") if same_rank else F.max_by("v", F.when(F.col("v").isNotNull(), order))
    of_slot = dealt.groupBy(group, "slot").agg(last.alias("l"))
    before = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = of_slot.select(group, "slot", (F.max("l") if same_rank else F.last("l", ignorenulls=True)).over(before).alias("ahead"))
    within = Window.partitionBy(group, "slot")
    if same_rank:
        own = F.max("v").over(within.orderBy(rank).rangeBetween(Window.unboundedPreceding, 0))
        found = F.greatest("own", "ahead")
    else:
        own = F.last("v", ignorenulls=True).over(within.orderBy(F.col(rank), *ties).rowsBetween(Window.unboundedPreceding, 0))
        found = F.coalesce("own", "ahead")
    return dealt.withColumn("own", own).join(ahead, [group, "slot"]).withColumn(name, found).drop("slot", "ahead", "own", "v")


def within_budget(rows: DataFrame, group: str, rank: str, ties: Sequence[str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each group's order whose sizes add up to the budget at most."""
    return running_total(rows, group, rank, ties, size).where(F.col("running") <= budget)


def optional_evidence(items: DataFrame, group: str, protected: Column, priority: str, ties: Sequence[str], chars: str, target: int, base: int) -> DataFrame:
    """items with `kept`: all protected ones, and the longest prefix of the others by priority for which the pack's JSON stays within the
    target. An item takes its characters and the two that part it from the next one; base is what the pack has without items."""
    each = items.withColumn("protected", protected).withColumn("cost", F.col(chars) + 2)
    fixed = each.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("protected"), F.col("cost"))), F.lit(0)).alias("fixed"))
    rest = running_total(each.where("not protected"), group, priority, ties, "cost")
    told = each.where("protected").withColumn("running", F.lit(0).cast("long")).unionByName(rest)
    return told.join(fixed, group).withColumn("kept", F.col("protected") | (F.col("running") + F.col("fixed") + base <= target)).drop("fixed", "cost")


def trimmed(strings: DataFrame, group: str, key: str, chars: str, target: int, floor: int) -> DataFrame:
    """strings with `left`, the characters that each keeps: the longest are cut first, each down to the floor, until the group's excess over
    the target is gone."""
    total = strings.groupBy(group).agg((F.sum(chars) - target).alias("excess_"))
    return trimmed_to(strings.join(total, group), group, key, chars, F.col("excess_"), floor).drop("excess_")


def trimmed_to(strings: DataFrame, group: str, key: str, chars: str, excess: Column, floor: int) -> DataFrame:
    """As trimmed, for an excess that every row tells (the same for all of its group)."""
    room = strings.withColumn("room", F.greatest(F.col(chars) - floor, F.lit(0))).withColumn("shorter", -F.col(chars))
    told = running_total(room, group, "shorter", [key], "room")
    cut = F.least(F.col("room"), F.greatest(excess - (F.col("running") - F.col("room")), F.lit(0)))
    return told.withColumn("left", (F.col(chars) - cut).cast("long")).drop("room", "shorter", "running")
