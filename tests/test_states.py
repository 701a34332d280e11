"""Logs with their index, streams of checkpoints, diagnoses."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import diagnostics, runs
from evidra.sinks import generations
from evidra.streaming import checkpoints

SCHEMA = "event_id long, run string, at long, status string"


def events(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def state(spark, path):
    log = generations.read_log(spark, path, SCHEMA)
    index = generations.read_index(spark, path)
    return sorted(r["event_id"] for r in log.collect()), {} if index is None else {r["run"]: (r["revision"], r["status"]) for r in index.collect()}


def test_log_and_index_change_together(spark, tmp_path, monkeypatch):
    """Writers that die between log and index, or before their manifest, leave what was there; the next one goes on, and what they left is swept."""
    path = f"file://{tmp_path}/log"
    add = lambda *rows: generations.append(events(spark, *rows), path, "run", ["at", "event_id"])
    assert state(spark, path) == ([], {}) and generations.append(events(spark).where("false"), path, "run", ["at"]) is None
    assert add((1, "a", 10, "started"), (2, "b", 11, "started")).number == 1
    assert add((1, "a", 10, "started"), (3, "a", 12, "finished"), (3, "a", 12, "finished")).number == 2
    whole = ([1, 2, 3], {"a": (2, "finished"), "b": (1, "started")})
    assert state(spark, path) == whole
    assert add((2, "b", 11, "started")).number == 2  # nothing new: nothing is written
    real, commit = generations.indexed, generations._commit

    def dies(*_):
        raise RuntimeError("killed")

    for name in ("indexed", "_commit"):
        monkeypatch.setattr(generations, name, dies)
        with pytest.raises(RuntimeError, match="killed"):
            add((4, "b", 13, "failed"))
        assert state(spark, path) == whole
        monkeypatch.undo()
    assert (generations.indexed, generations._commit) == (real, commit)
    (tmp_path / "log/manifests/000000000003.json").write_text('{"body": {"log": [')  # cut short
    assert state(spark, path) == whole
    assert add((4, "b", 13, "failed")).number == 4
    assert state(spark, path) == ([1, 2, 3, 4], {"a": (2, "finished"), "b": (2, "failed")})
    assert generations.swept(spark, path) >= 3 and state(spark, path)[0] == [1, 2, 3, 4]
    told = json.loads((tmp_path / "log/manifests/000000000004.json").read_text())
    assert len(told["body"]["log"]) == 3


def test_a_writer_that_was_overtaken_begins_anew(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    generations.append(events(spark, (1, "a", 10, "started")), path, "run", ["at", "event_id"])
    commit, first = generations._commit, []

    def overtaken(session, where, number, body):
        if not first:
            first.append(number)
            monkeypatch.setattr(generations, "_commit", commit)
            generations.append(events(spark, (7, "a", 20, "failed")), path, "run", ["at", "event_id"])
        return commit(session, where, number, body)

    monkeypatch.setattr(generations, "_commit", overtaken)
    assert generations.append(events(spark, (2, "a", 11, "finished")), path, "run", ["at", "event_id"]).number == 3
    assert state(spark, path) == ([1, 2, 7], {"a": (3, "failed")})


STEPS = ("load", "pack", "provider", "report")


def test_plans_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Late, repeated and unordered events, over a restart between two loads; late ones don't undo what is newer."""
    rows = [(r, STEPS[(r + k) % 4], "completed" if (r * k) % 3 else "started", 100 * k + (r * 7) % 50, 10 * r + k) for r in range(9) for k in range(6)] + [(20, "unknown", "completed", 1, 900), (21, "provider", "started", 5, 901)]
    frame = spark.createDataFrame(rows, "run long, step string, status string, sec long, event_id long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    source = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    make = lambda: checkpoints.checkpoint_plans(stream(), "run", "step", F.col("status"), "ts", "event_id", STEPS, "provider")
    late = F.col("event_id") % 3 == 0
    frame.where(~late).repartition(2).write.parquet(source)
    batch = lambda f: sorted(map(tuple, runs.checkpoint_plan(f, "run", "step", F.col("status"), ["ts", "event_id"], STEPS, "provider").collect()))
    first = checkpoints.folded_plans(make(), "run", f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    assert sorted(map(tuple, first.collect())) == batch(frame.where(~late))
    frame.where(late).unionByName(frame.where("event_id < 40")).repartition(2).write.mode("append").parquet(source)
    second = checkpoints.folded_plans(make(), "run", f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    assert sorted(map(tuple, second.collect())) == batch(frame)
    assert {r["run"]: r["blocked"] for r in second.collect()}[21]


def test_every_rule_of_a_pack_and_a_run(spark):
    """Each rule alone, at its border, and the order in which they are told."""
    facts = {n: 0 for n in ("led_materials", "short_materials", "attachments", "parsed", "core_parsed", "core_unparsed", "cache_hits", "cache_expired", "cache_failed", "primary_content", "auxiliary_content", "auxiliary_snippets", "full_chars", "compact_chars", "warnings", "weighted_chars", "summary_chars", "total_chars")}
    cases = {
        "OK": {}, "ATTACHMENT_LED_PRIMARY_MATERIAL": {"led_materials": 1}, "EVIDENCE_PRIMARY_TOO_SHORT": {"short_materials": 2}, "ATTACHMENTS_NOT_PARSED": {"attachments": 3}, "ATTACHMENTS_PARSED_SUMMARY_ONLY": {"attachments": 3, "parsed": 1},
        "CORE_ATTACHMENT_SUMMARY_ONLY": {"attachments": 2, "parsed": 2, "core_parsed": 1}, "CORE_ATTACHMENT_NOT_PARSED,ATTACHMENTS_NOT_PARSED": {"attachments": 1, "core_unparsed": 1}, "AUXILIARY_TOO_DOMINANT": {"auxiliary_content": 2001, "primary_content": 1000},
        "PACK_NEAR_LIMIT": {"compact_chars": 75_001, "full_chars": 75_001}, "PACK_COMPACTED": {"compact_chars": 1000, "full_chars": 1201}, "PACK_WARNINGS_EXIST": {"warnings": 1}, "ATTACHMENT_PARSE_CACHE_HIT,ATTACHMENT_PARSE_CACHE_EXPIRED,ATTACHMENT_PARSE_FAILED_SHORT_CACHED": {"cache_hits": 1, "cache_expired": 1, "cache_failed": 1},
    }
    rows = [{"pack": k, "compression_applied": False, "evidence_level": "low", **facts, **v} for k, v in cases.items()]
    rows += [{**rows[0], "pack": "border", "auxiliary_content": 2000, "primary_content": 1000, "compact_chars": 1000, "full_chars": 1200}, {**rows[6], "pack": "omitted", "compression_applied": True}]
    frame = spark.createDataFrame(rows)
    codes = F.array_join(F.transform("diagnosis", lambda x: x["code"]), ",").alias("codes")
    got = {r["pack"]: r["codes"] for r in diagnostics.pack_diagnostics(frame).select("pack", codes).collect()}
    assert got.pop("border") == "OK" and got.pop("omitted") == "CORE_ATTACHMENT_NOT_PARSED,ATTACHMENTS_NOT_PARSED,CORE_ATTACHMENT_OMITTED_RISK"
    assert got == {k: k for k in cases}
    report = [("a", "OK", 1200, 1200, False, False, False), ("b", "OK", 649, 1000, False, False, False), ("c", "OK", 650, 1000, True, True, True)]
    told = {r["run"]: r["codes"] for r in diagnostics.run_diagnostics(frame, spark.createDataFrame(report, "run string, pack string, report_chars long, first_chars long, truncated boolean, uncovered boolean, needs_review boolean")).select("run", codes).collect()}
    assert told == {"a": "OK", "b": "REVISION_SHRANK_REPORT", "c": "OUTPUT_MAY_BE_TRUNCATED,REPORT_MISSING_CORE_COVERAGE,QUALITY_GATE_NEEDS_MANUAL_REVIEW"}
    levels = frame.where("pack = 'OK'").drop("evidence_level", "weighted_chars", "total_chars").crossJoin(spark.createDataFrame([("low", 900, 1), ("medium", 4000, 1), ("high", 6000, 9000)], "evidence_level string, weighted_chars long, total_chars long")).withColumn("pack", F.col("evidence_level"))
    short = spark.createDataFrame([(x, x, n, 0, False, False, False) for x, n in (("low", 10), ("medium", 799), ("high", 799))], "run string, pack string, report_chars long, first_chars long, truncated boolean, uncovered boolean, needs_review boolean")
    told = {r["run"]: r["codes"] for r in diagnostics.run_diagnostics(levels, short).select("run", codes).collect()}
    assert told == {"low": "OK", "medium": "REPORT_TOO_SHORT_FOR_WEIGHTED_EVIDENCE", "high": "REPORT_TOO_SHORT_FOR_WEIGHTED_EVIDENCE,ONLY_SUMMARY_USED"}
