"""Diagnoses of packs and runs: rules as rows, over one aggregate for each pack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import evidence_level

# Weights of characters by where they are, for primary and auxiliary materials.
WEIGHTS = (
    ("primary_content", 1.0), ("primary_facts", 1.0), ("primary_file_summary", 0.7), ("primary_table_summary", 0.6), ("auxiliary_snippets", 0.5),
    ("auxiliary_summary", 0.3), ("auxiliary_content", 0.2), ("auxiliary_file_summary", 0.3), ("auxiliary_table_summary", 0.3),
)
# Statuses of attachments that can be used; body below which a material needs its attachments.
USABLE, SHORT_BODY, NEAR_LIMIT, COMPACTED = ("parsed_summary", "parsed_table_summary"), 800, 75_000, 1.2
#: Rules of a pack: code, level, condition over its facts. All that hold are told, in this order.
PACK_RULES = (
    ("ATTACHMENT_LED_PRIMARY_MATERIAL", "normal", "led_materials > 0"),
    ("EVIDENCE_PRIMARY_TOO_SHORT", "warning", "short_materials > 0"),
    ("CORE_ATTACHMENT_NOT_PARSED", "warning", "core_unparsed > 0"),
    ("ATTACHMENTS_NOT_PARSED", "warning", "attachments > 0 and parsed = 0"),
    ("CORE_ATTACHMENT_SUMMARY_ONLY", "normal", "parsed > 0 and core_parsed > 0"),
    ("ATTACHMENTS_PARSED_SUMMARY_ONLY", "normal", "parsed > 0 and core_parsed = 0"),
    ("ATTACHMENT_PARSE_CACHE_HIT", "normal", "cache_hits > 0"),
    ("ATTACHMENT_PARSE_CACHE_EXPIRED", "normal", "cache_expired > 0"),
    ("ATTACHMENT_PARSE_FAILED_SHORT_CACHED", "warning", "cache_failed > 0"),
    ("AUXILIARY_TOO_DOMINANT", "warning", "auxiliary_content > greatest(primary_content * 2, 2000) and auxiliary_snippets < auxiliary_content * 0.25"),
    ("PACK_NEAR_LIMIT", "warning", f"compact_chars > {NEAR_LIMIT}"),
    ("PACK_COMPACTED", "warning", f"compact_chars > 0 and full_chars > compact_chars * {COMPACTED}"),
    ("CORE_ATTACHMENT_OMITTED_RISK", "warning", "compression_applied and core_unparsed > 0"),
    ("PACK_WARNINGS_EXIST", "warning", "warnings > 0"),
)
#: Rules of a run, beside those of its pack: over the pack's facts and the run's own.
RUN_RULES = (
    ("REPORT_TOO_SHORT_FOR_WEIGHTED_EVIDENCE", "warning", "(evidence_level = 'medium' and report_chars < 800) or (evidence_level in ('high', 'very_high') and report_chars < 1200)"),
    ("REVISION_SHRANK_REPORT", "warning", "first_chars > 0 and report_chars > 0 and report_chars < first_chars * 0.65"),
    ("ONLY_SUMMARY_USED", "warning", "weighted_chars > 5000 and report_chars < 800 and summary_chars < total_chars * 0.35"),
    ("OUTPUT_MAY_BE_TRUNCATED", "warning", "truncated"),
    ("REPORT_MISSING_CORE_COVERAGE", "warning", "uncovered"),
    ("QUALITY_GATE_NEEDS_MANUAL_REVIEW", "warning", "needs_review"),
)
OK = "OK"


def pack_facts(materials: DataFrame, attachments: DataFrame, packs: DataFrame) -> DataFrame:
    """One row for each pack. materials: pack, role, material, content, summary, facts, snippets (characters); attachments: pack, role,
    material, core (boolean), parse_status, cache_status, summary, tables (characters); packs: pack, full_chars, compact_chars,
    compression_applied, warnings.

    Attachments are first counted by material, to see which materials they lead; then everything is one aggregate."""
    c = F.col
    usable = c("parse_status").isin(*USABLE)
    files = attachments.groupBy("pack", "role", "material").agg(
        F.count(F.lit(1)).alias("attachments"), F.count_if(usable).alias("parsed"), F.count_if(c("core") & usable).alias("core_parsed"), F.count_if(c("core") & ~usable).alias("core_unparsed"),
        F.count_if(c("cache_status") == "cache_hit_success").alias("cache_hits"), F.count_if(c("cache_status") == "cache_expired_retry").alias("cache_expired"), F.count_if(c("cache_status") == "cache_hit_failure_short").alias("cache_failed"),
        F.sum("summary").alias("file_summary"), F.sum("tables").alias("table_summary"),
    )
    told = materials.join(files, ["pack", "role", "material"], "left").fillna(0)
    primary, led = c("role") == "primary", (c("content") < SHORT_BODY) & (c("core_parsed") > 0)
    of = lambda role, column, name: F.sum(F.when(c("role") == role, c(column)).otherwise(0)).cast("long").alias(name)
    parts = [of(role, column, f"{role}_{name}") for role in ("primary", "auxiliary") for column, name in (("content", "content"), ("summary", "summary"), ("file_summary", "file_summary"), ("table_summary", "table_summary"))]
    counts = ("attachments", "parsed", "core_parsed", "core_unparsed", "cache_hits", "cache_expired", "cache_failed")
    one = told.groupBy("pack").agg(
        F.count_if(primary & led).alias("led_materials"), F.count_if(primary & (c("content") < SHORT_BODY) & ~led).alias("short_materials"), *(F.sum(n).cast("long").alias(n) for n in counts),
        *parts, of("primary", "facts", "primary_facts"), of("auxiliary", "snippets", "auxiliary_snippets"),
    )
    weighted = sum((c(n) * w for n, w in WEIGHTS), F.lit(0.0))
    total = sum((c(n) for n in dict.fromkeys([*(n for n, _ in WEIGHTS), "primary_summary"])), F.lit(0))
    one = one.withColumns({"weighted_chars": F.floor(F.round(weighted, 6)), "total_chars": total.cast("long"), "summary_chars": c("primary_summary") + c("auxiliary_summary")})
    return one.withColumn("evidence_level", evidence_level(c("weighted_chars"))).join(packs, "pack")


def diagnoses(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Structs (code, level) of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(F.expr(f"coalesce({condition}, false)"), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, condition in rules)))


def told(found: Column) -> Column:
    """The diagnoses, or that all is well."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(OK).alias("code"), F.lit("normal").alias("level"))))


def pack_diagnostics(facts: DataFrame, rules: Sequence[tuple[str, str, str]] = PACK_RULES) -> DataFrame:
    return facts.withColumn("diagnosis", told(diagnoses(rules)))


def run_diagnostics(facts: DataFrame, runs: DataFrame, rules: Sequence[tuple[str, str, str]] = RUN_RULES) -> DataFrame:
    """facts of packs with the runs on them. runs: run, pack, report_chars (of the newest version), first_chars (of the first), truncated,
    uncovered, needs_review."""
    return facts.join(runs, "pack").withColumn("diagnosis", told(F.concat(diagnoses(PACK_RULES), diagnoses(rules))))


def version_sizes(versions: DataFrame, run: str, order: Sequence[str], chars: Column) -> DataFrame:
    """(run, first_chars, report_chars, versions): first and newest version of each run's report in one aggregate."""
    place = F.struct(*order)
    return versions.groupBy(run).agg(F.min_by(chars, place).cast("long").alias("first_chars"), F.max_by(chars, place).cast("long").alias("report_chars"), F.count(F.lit(1)).alias("versions"))
