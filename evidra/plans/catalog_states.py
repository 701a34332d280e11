"""Queries over logs with their index, streams of checkpoints, and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import diagnostics
from evidra.plans.catalog_packs import _SQL_FIELDS, LIMIT, _fields
from evidra.plans.catalog_runs import _STEPS
from evidra.plans.registry import SQL, query
from evidra.sinks import generations
from evidra.sources import table
from evidra.sources.staging import shared_dir
from evidra.streaming import checkpoints


@query("""
select user_id, count(*) as revision, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by 1""")
def indexed_log(spark, d):
    """A log written in two parts, the second of which repeats the first; the index of the newest generation."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    path = shared_dir(spark)
    for part in (rows.where("event_id % 2 = 0"), rows):
        generations.append(part, path, "user_id", ["at", "event_id"])
    return generations.read_index(spark, path).drop("at")


@query(SQL["checkpoint_plan"])
def checkpoint_stream(spark, d):
    """The plans of runs, folded from a stream of their events, which come in three batches and in no order."""
    rows, source = table(spark, d, "events"), shared_dir(spark)
    rows.repartition(3, "event_id").write.parquet(source)
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    status = F.when(F.col("value") > 30, "completed").otherwise("started")
    return checkpoints.plans_of_files(events, "user_id", "event_type", status, "ts", "event_id", _STEPS, "signup")


_SQL_FACTS = f"""{_SQL_FIELDS}, g as (select pack, role, material, coalesce(sum(length(text)) filter (attachment < 0 and field = 'content_text'), 0) as content, coalesce(sum(length(text)) filter (attachment < 0 and field = 'summary'), 0) as summary,
 coalesce(sum(length(text)) filter (attachment < 0 and field = 'policy_rules'), 0) as facts, coalesce(sum(length(text)) filter (attachment < 0 and field = 'warnings'), 0) as snippets from f group by 1, 2, 3),
 h as (select pack, role, material, attachment, attachment % 3 = 0 as core, case when bool_or(regexp_matches(text, '[0-9]')) then 'parsed_table_summary' when sum(length(text)) > 400 then 'parsed_summary' else 'metadata_only' end as status,
 sum(case when field = 'summary' then length(text) else 0 end) as fs, sum(case when field = 'sections' then length(text) else 0 end) as ts from f where attachment >= 0 group by 1, 2, 3, 4),
 a as (select pack, role, material, count(*) as n, count(*) filter (status <> 'metadata_only') as parsed, count(*) filter (core and status <> 'metadata_only') as core_parsed, count(*) filter (core and status = 'metadata_only') as core_unparsed,
 count(*) filter (attachment % 4 = 0) as hits, count(*) filter (attachment % 4 = 1) as expired, count(*) filter (attachment % 4 = 2) as failed, sum(fs) as fs, sum(ts) as ts from h group by 1, 2, 3),
 m2 as (select g.*, coalesce(n, 0) as n, coalesce(parsed, 0) as parsed, coalesce(core_parsed, 0) as core_parsed, coalesce(core_unparsed, 0) as core_unparsed, coalesce(hits, 0) as hits, coalesce(expired, 0) as expired, coalesce(failed, 0) as failed, coalesce(fs, 0) as fs, coalesce(ts, 0) as ts,
 g.role = 'primary' as p from g left join a using (pack, role, material)),
 w as (select pack, sum(length(text)) as full_chars, least(sum(length(text)), {LIMIT}) as compact, sum(length(text)) > {LIMIT} as applied, count(*) filter (attachment < 0 and field = 'warnings' and contains(text, 'password')) as warnings from f group by 1),
 k as (select pack, count(*) filter (p and content < 800 and core_parsed > 0) as led, count(*) filter (p and content < 800 and core_parsed = 0) as short, sum(n) as n, sum(parsed) as parsed, sum(core_parsed) as core_parsed, sum(core_unparsed) as core_unparsed,
 sum(hits) as hits, sum(expired) as expired, sum(failed) as failed, sum(case when p then content else 0 end) as pc, sum(case when p then facts else 0 end) as pf, sum(case when p then fs else 0 end) as pfs, sum(case when p then ts else 0 end) as pts, sum(case when p then summary else 0 end) as ps,
 sum(case when not p then content else 0 end) as ac, sum(case when not p then snippets else 0 end) as asn, sum(case when not p then summary else 0 end) as su, sum(case when not p then fs else 0 end) as afs, sum(case when not p then ts else 0 end) as ats from m2 group by 1),
 q as (select *, cast(floor(round(pc + pf + pfs * 0.7 + pts * 0.6 + asn * 0.5 + su * 0.3 + ac * 0.2 + afs * 0.3 + ats * 0.3, 6)) as bigint) as weighted, pc + pf + pfs + pts + ps + ac + asn + su + afs + ats as total from k join w using (pack)),
 z as (select *, case when weighted < 1000 then 'low' when weighted < 5000 then 'medium' when weighted < 12000 then 'high' else 'very_high' end as evidence_level,
 list_filter([case when led > 0 then 'ATTACHMENT_LED_PRIMARY_MATERIAL' end, case when short > 0 then 'EVIDENCE_PRIMARY_TOO_SHORT' end, case when core_unparsed > 0 then 'CORE_ATTACHMENT_NOT_PARSED' end, case when n > 0 and parsed = 0 then 'ATTACHMENTS_NOT_PARSED' end,
 case when parsed > 0 and core_parsed > 0 then 'CORE_ATTACHMENT_SUMMARY_ONLY' end, case when parsed > 0 and core_parsed = 0 then 'ATTACHMENTS_PARSED_SUMMARY_ONLY' end, case when hits > 0 then 'ATTACHMENT_PARSE_CACHE_HIT' end, case when expired > 0 then 'ATTACHMENT_PARSE_CACHE_EXPIRED' end,
 case when failed > 0 then 'ATTACHMENT_PARSE_FAILED_SHORT_CACHED' end, case when ac > greatest(pc * 2, 2000) and asn < ac * 0.25 then 'AUXILIARY_TOO_DOMINANT' end, case when compact > 75000 then 'PACK_NEAR_LIMIT' end, case when full_chars > compact * 1.2 then 'PACK_COMPACTED' end,
 case when applied and core_unparsed > 0 then 'CORE_ATTACHMENT_OMITTED_RISK' end, case when warnings > 0 then 'PACK_WARNINGS_EXIST' end], lambda x: x is not null) as codes from q)"""


def _pack_facts(rows):
    n, own = F.length("text"), F.col("attachment") < 0
    of = lambda field, name: F.coalesce(F.sum(F.when(own & (F.col("field") == field), n)), F.lit(0)).alias(name)
    materials = rows.groupBy("pack", "role", "material").agg(of("content_text", "content"), of("summary", "summary"), of("policy_rules", "facts"), of("warnings", "snippets"))
    files = rows.where(~own).groupBy("pack", "role", "material", "attachment").agg(
        F.bool_or(F.regexp_like("text", F.lit("[0-9]"))).alias("numbers"), F.sum(n).alias("n"), F.sum(F.when(F.col("field") == "summary", n).otherwise(0)).alias("summary"), F.sum(F.when(F.col("field") == "sections", n).otherwise(0)).alias("tables")
    )
    status = F.when(F.col("numbers"), "parsed_table_summary").when(F.col("n") > 400, "parsed_summary").otherwise("metadata_only")
    cache = F.element_at(F.array(*map(F.lit, ("cache_hit_success", "cache_expired_retry", "cache_hit_failure_short", "cache_miss"))), F.col("attachment") % 4 + 1)
    files = files.select("pack", "role", "material", (F.col("attachment") % 3 == 0).alias("core"), status.alias("parse_status"), cache.alias("cache_status"), "summary", "tables")
    warned = own & (F.col("field") == "warnings") & F.contains("text", F.lit("password"))
    whole = rows.groupBy("pack").agg(F.sum(n).alias("full_chars"), F.count_if(warned).alias("warnings"))
    whole = whole.select("pack", "full_chars", F.least("full_chars", F.lit(LIMIT)).alias("compact_chars"), (F.col("full_chars") > LIMIT).alias("compression_applied"), "warnings")
    return diagnostics.pack_facts(materials, files, whole)


@query(f"with {_SQL_FACTS} select pack, weighted as weighted_chars, evidence_level, case when len(codes) = 0 then 'OK' else array_to_string(codes, ',') end as diagnosis from z")
def evidence_diagnostics(spark, d):
    """All rules of a pack over one aggregate."""
    found = diagnostics.pack_diagnostics(_pack_facts(_fields(spark, d).drop("lang")))
    return found.select("pack", "weighted_chars", "evidence_level", F.array_join(F.transform("diagnosis", lambda x: x["code"]), ",").alias("diagnosis"))


@query(f"""
with {_SQL_FACTS}, v as (select source || '/' || (doc_id // 200) as pack, arg_min(length(text), doc_id) as first_chars, arg_max(length(text), doc_id) as report_chars, arg_max(right(text, 1) not in ('.', '!', '?'), doc_id) as truncated,
 not bool_or(coalesce(quality = 1, false)) as uncovered, bool_or(coalesce(toxic = 1, false)) as review from documents left join labels using (doc_id) group by 1),
r as (select pack, list_concat(codes, list_filter([case when (evidence_level = 'medium' and report_chars < 800) or (evidence_level in ('high', 'very_high') and report_chars < 1200) then 'REPORT_TOO_SHORT_FOR_WEIGHTED_EVIDENCE' end,
 case when first_chars > 0 and report_chars > 0 and report_chars < first_chars * 0.65 then 'REVISION_SHRANK_REPORT' end, case when weighted > 5000 and report_chars < 800 and ps + su < total * 0.35 then 'ONLY_SUMMARY_USED' end, case when truncated then 'OUTPUT_MAY_BE_TRUNCATED' end,
 case when uncovered then 'REPORT_MISSING_CORE_COVERAGE' end, case when review then 'QUALITY_GATE_NEEDS_MANUAL_REVIEW' end], lambda x: x is not null)) as codes, first_chars, report_chars from z join v using (pack))
select pack, first_chars, report_chars, case when len(codes) = 0 then 'OK' else array_to_string(codes, ',') end as diagnosis from r""")
def run_diagnostics(spark, d):
    """The rules of a run with those of its pack: the pack's documents in order are the versions of a report."""
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    docs = table(spark, d, "documents").withColumn("run", F.concat("source", F.lit("/"), F.expr("doc_id div 200"))).join(labels, "doc_id", "left")
    sizes = diagnostics.version_sizes(docs, "run", ["doc_id"], F.length("text"))
    flags = docs.groupBy("run").agg(F.max_by(~F.right("text", F.lit(1)).isin(".", "!", "?"), "doc_id").alias("truncated"), (~F.bool_or(F.coalesce("good", F.lit(False)))).alias("uncovered"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("needs_review"))
    runs = sizes.join(flags, "run").withColumn("pack", F.col("run"))
    found = diagnostics.run_diagnostics(_pack_facts(_fields(spark, d).drop("lang")), runs)
    return found.select("pack", "first_chars", "report_chars", F.array_join(F.transform("diagnosis", lambda x: x["code"]), ",").alias("diagnosis"))
