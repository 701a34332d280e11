"""Runs folded from events: revisions, durations, states, checkpoints, consistency, attribution, timings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.budgets import running_total

#: States in which a run has ended.
TERMINAL = ("finished", "failed", "needs_manual_review", "interrupted")


def revisions(events: DataFrame, key: str, time: str, ties: Sequence[str]) -> DataFrame:
    """events with their revision: 1, 2, ... in order within a run. A run with very many events is numbered in slots of the time."""
    rows = events.withColumn("at", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("one", F.lit(1))
    return running_total(rows, key, "at", ties, "one", "revision").drop("at", "one")


def unix_ms(c: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest (halves away from 0), as the engines of SQL give them; `unix_millis` cuts off."""
    return (F.round(F.unix_micros(c.cast("timestamp")), -3) / 1000).cast("long")


def duration_ms(explicit: Column, timings: Sequence[Column], terminal: Column, started: Column, ended: Column) -> Column:
    """An explicit duration above 0, else the first timing that isn't 0, else for an ended run the time between its ends, else 0."""
    between = F.when(terminal & (ended >= started), unix_ms(ended) - unix_ms(started))
    return F.coalesce(F.when(explicit > 0, explicit), *[F.when(t != 0, t) for t in timings], between, F.lit(0)).cast("long")


def history_quality(status: Column, deliverable: Column, passed: Column, manual: Column, gate: Column) -> Column:
    """The quality of a run in its history, where the gate's own state counts as well."""
    return F.when(~status.isin(*TERMINAL), "pending").when(deliverable & passed, "passed").when(manual | (gate == "needs_manual_review"), "needs_manual_review").otherwise("failed")


def run_quality(status: Column, deliverable: Column, passed: Column, manual: Column) -> Column:
    """The quality of a run as an evaluation sees it, from the run alone."""
    return F.when(~status.isin(*TERMINAL), "pending").when(deliverable & passed, "passed").when(manual, "needs_manual_review").otherwise("failed")


def checkpoint_plan(events: DataFrame, run: str, step: str, status: Column, order: Sequence[str], steps: Sequence[str], external: str) -> DataFrame:
    """(run, blocked, error, resumed_from, next_step, skipped): from the latest status of each step. A run whose external step was started
    and not resolved is blocked, as nobody knows what came of it; else it goes on with its first step that isn't completed."""
    last = events.groupBy(run, step).agg(F.max_by(status, F.struct(*order)).alias("status"))
    done = F.collect_set(F.when(F.col("status") == "completed", F.col(step)))
    held = last.groupBy(run).agg(done.alias("done"), F.coalesce(F.bool_or((F.col(step) == external) & (F.col("status") == "started")), F.lit(False)).alias("blocked"))
    every = F.array(*map(F.lit, steps))
    skipped, left = F.filter(every, lambda s: F.array_contains("done", s)), F.filter(every, lambda s: ~F.array_contains("done", s))
    before = F.filter(F.array(*map(F.lit, steps[: list(steps).index(external)])), lambda s: F.array_contains("done", s))
    last_of = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    return held.select(
        run, "blocked", F.when(F.col("blocked"), "outcome_unknown").otherwise("").alias("error"), F.when(F.col("blocked"), last_of(before)).otherwise(last_of(skipped)).alias("resumed_from"),
        F.when(F.col("blocked"), "").otherwise(F.coalesce(F.try_element_at(left, F.lit(1)), F.lit(""))).alias("next_step"), F.array_join(skipped, ",").alias("skipped"),
    )


def timed_out(latest: DataFrame, run: str, time: str, status: Column, now: Column, seconds: float) -> DataFrame:
    """(run, status, timed_out): runs that haven't ended and whose last sign is older than the limit are failed."""
    late = ~status.isin(*TERMINAL) & (unix_ms(now) - unix_ms(F.col(time)) > F.lit(int(1000 * seconds)))
    return latest.select(run, F.when(late, "failed").otherwise(status).alias("status"), late.alias("timed_out"))


def consistency(runs: DataFrame, history: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, consistent, mismatches): names of the fields in which a run and its history differ, null equal to null."""
    a = runs.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = history.select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    wrong = F.filter(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return a.join(b, key, "left").select(key, (F.size(wrong) == 0).alias("consistent"), F.array_join(wrong, ",").alias("mismatches"))


def attribution(stages: DataFrame, run: str, layers: Sequence[str], codes: Mapping[str, Sequence[str]], canonical: Mapping[str, str]) -> DataFrame:
    """(run, primary_layer, primary_code, secondary): stages are (run, layer, status, code). Codes are brought to their canonical names; of a
    layer's stages the blocked ones count first, then by the priority of their codes, then by code; the first blocked layer is primary."""
    name = F.coalesce(F.map_from_arrays(F.array(*map(F.lit, canonical)), F.array(*map(F.lit, canonical.values())))[F.col("code")], F.col("code")) if canonical else F.col("code")
    rank = F.when(F.col("status") == "blocked", 0).when(F.col("status") == "ok", 1).when(F.col("status") == "skipped", 2).otherwise(3)
    by_code = F.lit(1_000)
    for layer, known in codes.items():
        for i, code in enumerate(known):
            by_code = F.when((F.col("layer") == layer) & (F.col("code") == code), i).otherwise(by_code)
    best = stages.withColumn("code", F.when(F.col("status") == "blocked", F.coalesce(F.when(name != "", name), F.lit("UNCLASSIFIED"))).otherwise("")).groupBy(run, "layer").agg(F.min(F.struct(rank.alias("r"), by_code.alias("c"), "code")).alias("x"))
    place = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    blocked = F.sort_array(F.collect_list(F.when(F.col("x.r") == 0, F.struct(place.alias("at"), "layer", F.col("x.code").alias("code")))))
    out = best.groupBy(run).agg(blocked.alias("b"))
    first = F.try_element_at("b", F.lit(1))
    rest = F.filter(F.transform(F.slice("b", 2, len(layers)), lambda s: s.code), lambda c: c != first.code)
    return out.select(run, F.coalesce(first.layer, F.lit("")).alias("primary_layer"), F.coalesce(first.code, F.lit("")).alias("primary_code"), F.array_join(rest, ",").alias("secondary"))


def merged_timings(observations: DataFrame, run: str, field: str, value: str, status: str, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """(run, field, value, status) for each field: the largest observed value of a field and of its alias; a failed collection of one of
    the two empties both; a field that nobody observed is not_observed."""
    other = {a: b for a, b in aliases} | {b: a for a, b in aliases}
    names = F.array(F.col(field), *[F.when(F.col(field) == a, F.lit(b)) for a, b in other.items()])
    rows = observations.select(run, F.explode(F.array_compact(names)).alias(field), value, status)
    failed = F.bool_or(F.col(status) == "collection_failed")
    out = rows.groupBy(run, field).agg(failed.alias("f"), F.max(F.when(F.col(status) == "observed", F.col(value))).alias("v"))
    return out.select(run, field, F.when(~F.col("f"), F.col("v")).alias(value), F.when(F.col("f"), "collection_failed").when(F.col("v").isNull(), "not_observed").otherwise("observed").alias(status))


def identities(primary: DataFrame, auxiliary: DataFrame, key: str) -> DataFrame:
    """(role, key) of both, each once; a record may have both roles."""
    of = lambda rows, role: rows.where(F.col(key).isNotNull()).select(F.lit(role).alias("role"), key).distinct()
    return of(primary, "primary").unionByName(of(auxiliary, "auxiliary"))


def ordered_union(primary: DataFrame, auxiliary: DataFrame, key: str, order: str) -> DataFrame:
    """(key, role, place): primary keys in order, then auxiliary ones, each key once by its first place. The places are told from 1."""
    both = primary.select(key, order, F.lit(0).alias("r")).unionByName(auxiliary.select(key, order, F.lit(1).alias("r")))
    first = both.groupBy(key).agg(F.min(F.struct("r", order)).alias("x"))
    return first.select(key, F.when(F.col("x.r") == 0, "primary").otherwise("auxiliary").alias("role"), F.col(f"x.{order}").alias(order))
