"""Evaluation of runs: summaries, baselines, manifests, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.selection import nearest_ranks

#: Counts that must be 0, and counts that must reach all samples, before a baseline counts.
NONE_OF, ALL_OF = ("failed_count", "forbidden_count", "contradiction_count", "missing_id_count"), ("hash_complete_count", "metrics_complete_count", "replayable_count")


def summary(samples: DataFrame, case: str, flags: Mapping[str, Column], sums: Mapping[str, Column], size: str, seconds: str) -> DataFrame:
    """One row: how many samples and cases, how many have each flag, the sums, and the range of sizes and seconds with nearest ranks."""
    told = samples.agg(
        F.count(F.lit(1)).alias("sample_count"), F.countDistinct(case).alias("case_count"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
        F.coalesce(F.min(size), F.lit(0)).alias(f"{size}_min"), F.coalesce(F.max(size), F.lit(0)).alias(f"{size}_max"), F.coalesce(F.round(F.avg(size), 3), F.lit(0.0)).alias(f"{size}_mean"),
    )
    found = nearest_ranks(samples.select(F.lit(1).alias("all_"), seconds), ["all_"], seconds, (0.5, 0.95))
    ranks = [F.coalesce(F.max(F.when(F.col("p") == p / 100, F.col("found"))), F.lit(0)).alias(f"{seconds}_p{p}") for p in (50, 95)]
    return told.withColumn("all_", F.lit(1)).join(found.agg(*ranks).withColumn("all_", F.lit(1)), "all_").drop("all_")


def compared(current: DataFrame, frozen: DataFrame, p95: str, deltas: Sequence[str], excluded: str) -> DataFrame:
    """One row from two summaries: each invariant (the same cases must be excluded, too), the differences of counts, whether p95 is within 1.3 times or 30 of the baseline's."""
    both = current.select(F.lit(1).alias("k"), F.struct("*").alias("c")).join(frozen.select(F.lit(1).alias("k"), F.struct("*").alias("b")), "k")
    holds = {n: F.col(f"c.{n}") == 0 for n in NONE_OF} | {n: F.col(f"c.{n}") == F.col("c.sample_count") for n in ALL_OF} | {excluded: F.col(f"c.{excluded}").eqNullSafe(F.col(f"b.{excluded}"))}
    limit = F.greatest(1.3 * F.col(f"b.{p95}"), F.col(f"b.{p95}") + 30)
    fast = F.col(f"c.{p95}") <= limit
    every = fast
    for h in holds.values():
        every = every & h
    return both.select(*[h.alias(f"holds_{n}") for n, h in holds.items()], *[(F.col(f"c.{n}") - F.col(f"b.{n}")).cast("long").alias(f"delta_{n}") for n in deltas], F.round(limit, 3).alias("p95_limit"), fast.alias("p95_passed"), every.alias("passed"))


def frozen_matches(frozen: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): whether a record still has the digest that was frozen: same, changed, missing or new."""
    both = frozen.select(key, F.col(digest).alias("a")).join(current.select(key, F.col(digest).alias("b")), key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


def sampled(rows: DataFrame, key: str, count: int, seed: int, forced: Column) -> DataFrame:
    """`count` rows whose choice depends on key and seed alone; a forced one is always among them."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.orderBy(F.when(forced, 0).otherwise(1), order, key).limit(count)


def strata(rows: DataFrame, key: str, predicates: Mapping[str, Column], order: Sequence[Column], used: DataFrame) -> DataFrame:
    """(stratum, key): for each predicate its first unused row in order, none taken twice; earlier strata choose first. A stratum that
    finds nothing takes the first of what is left. One row for each stratum, so the loop is over the predicates alone."""
    left = rows.join(used.select(key), key, "left_anti")
    found: list[tuple[str, object]] = []
    for name, holds in predicates.items():
        free = left.where(~F.col(key).isin([k for _, k in found])) if found else left
        pick = free.where(holds).orderBy(*order, key).limit(1).select(key).first() or free.orderBy(*order, key).limit(1).select(key).first()
        if pick:
            found.append((name, pick[0]))
    return rows.sparkSession.createDataFrame(found, f"stratum string, {key} {rows.schema[key].dataType.simpleString()}")


def violated(states: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, violation) for every rule that doesn't hold for a row; a rule that can't be told is violated."""
    wrong = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return states.select(key, F.explode(F.array_compact(wrong)).alias("violation"))


def versions(items: DataFrame, key: str, order: Sequence[str], keep: int) -> DataFrame:
    """The latest version of each item and the backups before it, `keep` at most: place 0 is current."""
    ranked = F.transform(F.sort_array(F.collect_list(F.struct(*order)), asc=False), lambda x: x)
    rows = items.groupBy(key).agg(F.slice(ranked, 1, keep + 1).alias("v"))
    return rows.select(key, F.posexplode("v").alias("place", "x")).select(key, F.col("place").cast("long").alias("place"), "x.*")


#: Codes of a run that failed before a gate saw it.
FAILED_CODES = ("RUN_FAILED", "DIAGNOSTICS_UNAVAILABLE")


def projected(runs: DataFrame, run: str, scores: Sequence[str]) -> DataFrame:
    """What an evaluation keeps of each run: (run, deliverable_status, blocking codes, scores). runs: gate_status, gate_codes (array), run_status,
    error_code, and the scores.

    A run without a gate takes its own state; one that failed has the codes of that; an error of the provider is told last, once, and
    then scores that nobody measured are 0."""
    gate, own, error = F.coalesce("gate_status", F.lit("")), F.coalesce("run_status", F.lit("")), F.trim(F.coalesce("error_code", F.lit("")))
    failed = (gate == "") & (own == "failed")
    status = F.when(gate != "", gate).when(own.isin("failed", "needs_manual_review"), own).otherwise("")
    codes = F.when(failed, F.array(*map(F.lit, FAILED_CODES))).otherwise(F.filter(F.coalesce("gate_codes", F.array().cast("array<string>")), lambda c: F.trim(c) != ""))
    codes = F.when((error != "") & ~F.array_contains(codes, error), F.concat(codes, F.array(error))).otherwise(codes)
    told = [F.coalesce(F.col(s), F.when(error != "", 0)).alias(s) for s in scores]
    return runs.select(run, status.alias("deliverable_status"), codes.alias("blocking_codes"), *told)
