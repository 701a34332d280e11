"""Gates over reports: what blocks them, in which order; results of checking models; repair of claims."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import hits
from evidra.operators.claims import contained
from evidra.operators.containment import text_index
from evidra.operators.facts import Rules

#: Codes of the domain gate, the first one that is there is the primary one.
PRIORITY = ("rule_conflict", "evidence_index_invalid", "c_level_used", "source_ref_invalid", "unsupported_claim", "section_missing", "topic_missing")
#: States of a check that block.
BLOCKING = ("needs_fix", "block", "blocked", "fail", "failed", "needs_human", "manual_review", "需人工确认")


def named_topics(report: Column, rules: Rules) -> Column:
    """The topics that a text names."""
    return F.filter(F.array(*[F.when(F.size(hits(report, words)) > 0, F.lit(t)) for t, words in rules.topics]), lambda t: t.isNotNull())


def domain_gate(reports: DataFrame, key: str, named: str, unsupported: str, facts: DataFrame, rules: Rules, headings: str | None = None, further: dict[str, Column] | None = None) -> DataFrame:
    """(key, status, primary_code, codes, missing_topics): conflicts between facts, unsupported claims, and required topics that have
    evidence but that the report doesn't name, and required sections that none of its headings (an array) names; `further` adds conditions for
    other codes of PRIORITY, such as claims that rest on level C. named: the topics that it names (of a long report, put together from its parts)."""
    held = facts.groupBy(key).agg(F.collect_set("fact_type").alias("held"), F.bool_or("conflict").alias("conflict"))  # as many as there are topics
    rows = reports.join(held, key, "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    missing = F.filter(F.array(*map(F.lit, rules.required)).cast("array<string>"), lambda t: F.array_contains("held", t) & ~F.array_contains(F.col(named), t))
    rows = rows.withColumn("missing", missing)
    found = {"rule_conflict": F.coalesce("conflict", F.lit(False)), "unsupported_claim": F.col(unsupported) > 0, "topic_missing": F.size("missing") > 0}
    if headings is not None and rules.sections:
        found["section_missing"] = F.size(missing_sections(F.col(headings), rules)) > 0
    codes = ordered_codes(found | (further or {}))
    return rows.withColumn("c", codes).select(
        key, F.when(F.size("c") > 0, "blocked").otherwise("passed").alias("status"), F.coalesce(F.try_element_at("c", F.lit(1)), F.lit("")).alias("primary_code"), F.array_join("c", ",").alias("codes"), F.array_join("missing", ",").alias("missing_topics")
    )


def missing_sections(headings: Column, rules: Rules) -> Column:
    """Ids of the required sections that no heading names."""
    there = lambda words: F.exists(headings, lambda h: F.size(hits(h, words)) > 0)
    return F.filter(F.array(*[F.when(~there(words), F.lit(name)) for name, words in rules.sections]), lambda x: x.isNotNull())


def ordered_codes(found: dict[str, Column], order: Sequence[str] = PRIORITY) -> Column:
    """The codes whose conditions hold, in the order of their priority."""
    return F.filter(F.array(*[F.when(found[c], F.lit(c)) for c in order if c in found]), lambda c: c.isNotNull())


def chain(reports: DataFrame, gates: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], key: str) -> DataFrame:
    """(key, passed, failed_gates): gates (name, function giving (key, passed)) one after the other; a report that a gate doesn't know
    doesn't pass it."""
    out = reports.select(key)
    for name, gate in gates:
        verdict = gate(reports).select(key, F.col("passed").alias(f"g_{name}"))
        out = out.join(verdict, key, "left")
    fails = F.filter(F.array(*[F.when(~F.coalesce(F.col(f"g_{n}"), F.lit(False)), F.lit(n)) for n, _ in gates]), lambda x: x.isNotNull())
    return out.select(key, (F.size(fails) == 0).alias("passed"), F.array_join(fails, ",").alias("failed_gates"))


def local_gate(reports: DataFrame, key: str, report: str, evidence: str, failed: Column, blocked: Column, marker: str, core_marker: str, technical: Sequence[str], depth: DataFrame) -> DataFrame:
    """(key, fidelity, unsupported, issues, verdict, evidence_present) for each report: 25 off for each marker that the evidence lacks, 20 for
    technical phrases. Issues: summary_only (by the analysis depth), core_missing (a core marker of the evidence that the report lacks),
    technical_note, check_blocked. Without evidence the fidelity is 100, which says nothing, and the report needs a review."""
    compact = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", "")
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)))
    rows = reports.join(depth.select(key, "summary_only"), key, "left").withColumn("r", compact(F.col(report))).withColumn("e", compact(F.col(evidence)))
    bad = F.size(F.filter(found(F.col(report), marker), lambda m: ~F.contains(F.col("e"), compact(m))))
    lost = F.size(F.filter(found(F.col(evidence), core_marker), lambda m: ~F.contains(F.col("r"), compact(m)))) > 0
    note = F.size(hits(F.coalesce(F.col(report), F.lit("")), technical)) > 0
    named = {"unsupported_fact": bad > 0, "summary_only": F.coalesce("summary_only", F.lit(True)), "core_missing": lost, "technical_note": note, "check_blocked": blocked}
    rows = rows.withColumn("there", F.col("e") != "").withColumn("bad", bad).withColumn("note", note).withColumn("i", ordered_codes(named, list(named)))
    fidelity = F.when(F.col("there"), F.greatest(F.lit(0), 100 - 25 * F.col("bad") - F.when(F.col("note"), 20).otherwise(0))).otherwise(100)
    verdict = F.when(failed | (F.col("r") == ""), "failed").when(~F.col("there") | (F.size("i") > 0), "needs_manual_review").otherwise("deliverable")
    issues = F.when(F.col("there"), F.array_join("i", ",")).when(F.col("r") != "", "no_evidence").otherwise("")
    return rows.select(key, fidelity.cast("long").alias("fidelity"), F.when(F.col("there"), F.col("bad")).otherwise(0).cast("long").alias("unsupported"), issues.alias("issues"), verdict.alias("verdict"), F.col("there").alias("evidence_present"))


def delivery(status: Column, body_safe: Column, repair_failed: Column, flagged: Column, gate: Column, passed: Column) -> Column:
    """Whether a run is deliverable, exportable, and exportable for good. It is explicitly deliverable when it has finished with a body and
    its gate says so (or, without a gate, its check passed)."""
    explicit = (status == "finished") & body_safe & F.when(gate != "", gate == "deliverable").otherwise(passed)
    safe = body_safe & ~repair_failed
    export = safe & status.isin("finished", "needs_manual_review") & flagged
    return F.struct((safe & explicit).alias("deliverable"), export.alias("exportable"), (export & safe & explicit).alias("final_export"))


def with_fallback(rows: DataFrame, key: str, report: Column, unusable: Column, fallback: Column) -> DataFrame:
    """(key, fallback, report, status): an unusable report is replaced, and fails closed: it needs a review."""
    return rows.select(key, unusable.alias("fallback"), F.when(unusable, fallback).otherwise(report).alias("report"), F.when(unusable, "needs_manual_review").otherwise("finished").alias("status"))


def first_object(text: str) -> str:
    """The first JSON object in a text: braces are counted outside strings, an open one gives nothing."""
    value = re.sub(r"(?is)<think(?:ing)?\b[^>]*>.*?</think(?:ing)?>", "", text or "")
    decoder, at = json.JSONDecoder(), value.find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(value, at)
            return value[at:end]
        except ValueError:
            at = value.find("{", at + 1)
    return ""


def _issues(value, severity: str) -> list[dict]:
    rows = value if isinstance(value, list) else [] if value is None else [value]
    out = []
    for x in rows:
        x = x if isinstance(x, dict) else {"text": x}
        out.append({"severity": str(x.get("severity") or severity).strip().lower(), "text": " ".join(str(x.get("report_text") or x.get("text") or x.get("claim") or "").split())})
    return out


def qa_result(rows: DataFrame, key: str, raw: str, severe: Sequence[str]) -> DataFrame:
    """(key, status, n_issues, blocks) from what a checking model wrote. It blocks by its status, or by a severe unsupported claim or
    leak; so does an answer without an object."""

    def parse(raw_text: str) -> tuple[str, int, bool]:
        try:
            data = json.loads(first_object(raw_text))
        except ValueError:
            return "unreadable", 0, True
        status = re.sub(r"[\s-]+", "_", str(data.get("status") or "pass").strip().lower())
        hard = _issues(data.get("unsupported_claims"), "major") + _issues(data.get("history_leakage"), "major")
        rest = _issues(data.get("issues"), "minor") + _issues(data.get("language_issues"), "minor")
        return status, len(hard) + len(rest), status in BLOCKING or any(i["severity"] in severe for i in hard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(x) for x in batch[raw]]
            yield pd.DataFrame({key: batch[key], "status": [f[0] for f in found], "n_issues": [f[1] for f in found], "blocks": [f[2] for f in found]})

    return rows.select(key, raw).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, status string, n_issues long, blocks boolean")


def narrowed(claims: DataFrame, evidence: DataFrame, claim_id: str, evidence_id: str, text: str, least: int = 6) -> DataFrame:
    """(claim_id, action, repaired): one attempt at each claim. One that the evidence holds is kept; else its clauses that the evidence
    holds are joined; else it is deleted. Nothing is written that no evidence has."""
    left = claims.select(F.col(claim_id).alias("claim"), F.col(text).alias("text"))
    right = evidence.select(F.col(evidence_id).alias("evidence"), F.col(text).alias("text"))
    index = text_index(right)
    whole = contained(left, index).select("claim").distinct().withColumn("whole", F.lit(True))
    told = left.join(whole, "claim", "left")
    parts = F.filter(F.transform(F.split("text", "[,;，；]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    clauses = told.where("whole is null").select("claim", F.posexplode(parts).alias("i", "part")).withColumn("clause", F.struct("claim", "i"))
    held = contained(clauses.select(F.col("clause").alias("claim"), F.col("part").alias("text")), index).select(F.col("claim").alias("clause")).distinct()
    kept = clauses.join(held, "clause", "left_semi").groupBy("claim").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x.part), ", ").alias("joined"))
    out = told.join(kept, "claim", "left")
    action = F.when(F.col("whole"), "kept").when(F.col("joined").isNotNull(), "narrowed").otherwise("deleted")
    return out.select(F.col("claim").alias(claim_id), action.alias("action"), F.when(F.col("whole"), F.col("text")).otherwise(F.coalesce("joined", F.lit(""))).alias("repaired"))


def new_facts(before: DataFrame, after: DataFrame, key: str, marker: str, text: str = "text") -> DataFrame:
    """(key, marker) that a repaired text has and the one before hasn't: such a repair is rejected."""
    of = lambda rows: rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(marker), F.lit(0)))).alias("marker"))
    return of(after).join(of(before), [key, "marker"], "left_anti")


# Words of notices on changed procedures, of what they are about, topics that a report on one needs, and its sections.
PROCESS_WORDS = ("流程调整", "操作流程", "申报挂网", "挂网操作", "申报入口", "申报路径", "联审通办", "提交申报")
PROCESS_SUBJECTS, PROCESS_SECTIONS = ("医用耗材", "挂网", "申报"), 3
PROCESS_TOPICS = (
    ("调整内容", ("调整内容", "流程调整", "申报入口", "操作流程", "申报路径", "联审通办")), ("影响分析", ("影响分析", "影响", "变化", "衔接", "申报节奏")), ("企业关注点", ("企业关注", "操作建议", "关注点", "企业需", "提前核对", "申报材料")),
)


def process_notice(compact: Column, words: Sequence[str] = PROCESS_WORDS, subjects: Sequence[str] = PROCESS_SUBJECTS) -> Column:
    """Whether a text without spaces is on a changed procedure: one of the words, and two of the subjects."""
    return (F.size(hits(compact, words)) >= 1) & (F.size(hits(compact, subjects)) >= 2)


def process_depth(report: Column, sections: Column, topics: Sequence[tuple[str, Sequence[str]]] = PROCESS_TOPICS, least: int = PROCESS_SECTIONS) -> Column:
    """(missing topics, shallow): what a report on a changed procedure lacks, from its text without spaces and its number of sections."""
    missing = F.array_compact(F.array(*(F.when(F.size(hits(report, words)) == 0, F.lit(topic)) for topic, words in topics)))
    return F.struct(missing.alias("missing"), ((sections < least) | (F.size(missing) > 0)).alias("shallow"))
