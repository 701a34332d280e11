"""Checkpoints of runs over a stream of their events: the latest status of every step is kept as state of its run, and the plan of how
the run goes on is emitted whenever it changes. Batch and stream give the same plans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.sources.staging import shared_dir

PLAN = "blocked boolean, error string, resumed_from string, next_step string, skipped string"


def plan_of(latest: dict[str, str], steps: Sequence[str], external: str) -> tuple[bool, str, str, str, str]:
    """The plan from the latest status of each step: blocked while nobody knows what came of the external step; else the first step that
    isn't completed is next."""
    done = [s for s in steps if latest.get(s) == "completed"]
    if latest.get(external) == "started":
        before = [s for s in done if steps.index(s) < steps.index(external)]
        return True, "outcome_unknown", before[-1] if before else "", "", ",".join(done)
    rest = [s for s in steps if s not in done]
    return False, "", done[-1] if done else "", rest[0] if rest else "", ",".join(done)


def checkpoint_plans(events: DataFrame, run: str, step: str, status: Column, time: str, event: str, steps: Sequence[str], external: str) -> DataFrame:
    """(run, plan) for every run whose plan has changed: events are a stream, in any order. A status counts if no later one of its step was
    seen, so repeated and late events change nothing. A run's state is one entry for each of the steps."""
    kind = events.schema[run].dataType.simpleString()
    rows = events.select(F.col(run).alias("run"), F.col(step).alias("step"), status.alias("status"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(event).cast("string").alias("event"), F.length(F.col(event).cast("string")).alias("size"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {s: (at, size, event, status) for s, at, size, event, status in zip(*state.get, strict=True)} if state.exists else {}
        before = plan_of({s: x[3] for s, x in held.items()}, steps, external) if held else None
        for batch in batches:
            for s, status, at, event, size in batch[["step", "status", "at", "event", "size"]].itertuples(index=False):
                seen = (int(at), int(size), event, status)
                if s in steps and (s not in held or seen[:3] > held[s][:3]):
                    held[s] = seen
        if held:
            names = list(held)
            state.update((names, *([held[s][k] for s in names] for k in range(4))))
        after = plan_of({s: x[3] for s, x in held.items()}, steps, external)
        if after != before:
            yield pd.DataFrame([(key[0], *after)], columns=["run", *(c.split()[0] for c in PLAN.split(", "))])

    state = "step array<string>, at array<long>, size array<long>, event array<string>, status array<string>"
    return rows.groupBy("run").applyInPandasWithState(fold, f"run {kind}, {PLAN}", state, "update", "NoTimeout").withColumnRenamed("run", run)


def folded_plans(plans: DataFrame, run: str, checkpoint: str, out: str) -> DataFrame:
    """Runs a stream of plans over what its source holds now, into the folder `out`, and gives the latest plan of each run. A batch that is
    repeated after a failure replaces what it has written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    plans.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = plans.sparkSession.read.parquet(out)
    rest = [c for c in plans.columns if c != run]
    return found.groupBy(run).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(run, "x.*")


def plans_of_files(events: DataFrame, run: str, step: str, status: Column, time: str, event: str, steps: Sequence[str], external: str) -> DataFrame:
    """The latest plans of a stream of files, with its checkpoint in the shared folder."""
    place = shared_dir(events.sparkSession)
    return folded_plans(checkpoint_plans(events, run, step, status, time, event, steps, external), run, f"{place}/checkpoint", f"{place}/plans")
