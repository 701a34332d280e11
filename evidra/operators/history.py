"""Event logs folded into runs, resume plans, comparisons and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.budgets import carried
from evidra.operators.selection import nearest_ranks


def latest(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last event of each key. max_by combines within tasks, so a hot key doesn't gather in one."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("revision")).select(key, "revision", "x.*")


def carry_forward(events: DataFrame, key: str, time: str, ties: list[str], column: str, filled: Column, name: str) -> DataFrame:
    """The last filled value of a column up to each event, in the order of time, then ties. A run with very many events is cut by time."""
    rows = events.withColumn("at", F.unix_micros(F.col(time).cast("timestamp")))
    return carried(rows, key, "at", ties, F.when(filled, F.col(column)), name).drop("at")


def resume_plan(events: DataFrame, key: str, step: str, order: list[Column], done: Column, steps: list[str]) -> DataFrame:
    """For each run the first step that isn't completed by its latest event, or null."""
    last = events.groupBy(key, step).agg(F.max_by(done, F.struct(*order)).alias("done"))
    held = last.where("done").groupBy(key).agg(F.collect_set(step).alias("held"))
    runs = events.select(key).distinct().join(held, key, "left")
    open_steps = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.array_contains(F.coalesce("held", F.array().cast("array<string>")), s))
    return runs.select(key, F.size(open_steps).cast("long").alias("open_steps"), F.try_element_at(open_steps, F.lit(1)).alias("next_step"))


def percentiles(values: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, n, and p50, p95 or as the points say): nearest-rank percentiles, exact, without a group's values in one task."""
    found = nearest_ranks(values, [group], value, points)
    named = [F.max(F.when(F.col("p") == p, F.col("found"))).alias(f"p{round(100 * p)}") for p in points]
    return values.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(found.groupBy(group).agg(*named), group, "left")


def differing(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) where a field differs; null equals null."""
    a = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    b = right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value")) for f in fields])
    rows = a.join(b, key).select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    return rows.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
