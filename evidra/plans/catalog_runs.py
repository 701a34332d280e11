"""Queries over runs, histories, caches, budgets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import text
from evidra.operators import budgets, caches, evaluate, facts, runs
from evidra.plans.registry import query, quoted
from evidra.sources import table

#: What the event types stand for.
_STATUS = {"view": "parsed_summary", "click": "metadata_only", "signup": "parsed_table_summary", "purchase": "parsed_text", "error": "download_failed"}
_SQL_STATUS = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in _STATUS.items()) + " end"


def _status(c="event_type"):
    out = F.lit(None).cast("string")
    for a, b in _STATUS.items():
        out = F.when(F.col(c) == a, b).otherwise(out)
    return out


@query(f"""
with e as (select user_id, {_SQL_STATUS} as status, value > 50 as core, case when value < 10 then 'cache_miss' when value < 30 then 'cache_hit_success' when value < 40 then 'cache_hit_failure_short' when value < 60 then 'cache_expired_retry' else 'force_refreshed' end as cache from events)
select user_id, count(*) as attachments, count(*) filter (core) as core, count(*) filter (core and status in ('parsed_summary', 'parsed_table_summary', 'parsed_text')) as core_parsed,
 count(*) filter (core and status not in ('parsed_summary', 'parsed_table_summary', 'parsed_text')) as core_unparsed, count(*) filter (status in ('parsed_summary', 'parsed_table_summary', 'parsed_text')) as parsed,
 count(*) filter (status = 'metadata_only') as metadata_only, count(*) filter (status = 'network_unreachable') as network_unreachable, count(*) filter (status in ('auth_required', 'auth_failed')) as auth_failed,
 count(*) filter (status in ('download_failed', 'network_unreachable')) as download_failed, count(*) filter (status in ('unsupported', 'parse_failed')) as parse_failed, count(*) filter (status = 'parsed_summary') as parsed_summary,
 count(*) filter (status = 'parsed_table_summary') as parsed_table_summary, count(*) filter (cache = 'cache_hit_success') as cache_hit_success, count(*) filter (cache = 'cache_hit_failure_short') as cache_hit_failure_short,
 count(*) filter (cache = 'cache_expired_retry') as cache_expired_retry, count(*) filter (cache = 'cache_miss') as cache_miss, count(*) filter (cache = 'force_refreshed') as force_refreshed from e group by 1""")
def attachment_counters(spark, d):
    v = F.col("value")
    cache = F.when(v < 10, "cache_miss").when(v < 30, "cache_hit_success").when(v < 40, "cache_hit_failure_short").when(v < 60, "cache_expired_retry").otherwise("force_refreshed")
    rows = table(spark, d, "events").select("user_id", _status().alias("status"), (v > 50).alias("core"), cache.alias("cache"))
    status, parsed, of = F.col("status"), F.col("status").isin("parsed_summary", "parsed_table_summary", "parsed_text"), lambda n: F.count_if(F.col("cache") == n).alias(n)
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("attachments"), F.count_if("core").alias("core"), F.count_if(F.col("core") & parsed).alias("core_parsed"), F.count_if(F.col("core") & ~parsed).alias("core_unparsed"), F.count_if(parsed).alias("parsed"),
        F.count_if(status == "metadata_only").alias("metadata_only"), F.count_if(status == "network_unreachable").alias("network_unreachable"), F.count_if(status.isin("auth_required", "auth_failed")).alias("auth_failed"),
        F.count_if(status.isin("download_failed", "network_unreachable")).alias("download_failed"), F.count_if(status.isin("unsupported", "parse_failed")).alias("parse_failed"), F.count_if(status == "parsed_summary").alias("parsed_summary"),
        F.count_if(status == "parsed_table_summary").alias("parsed_table_summary"), *map(of, ("cache_hit_success", "cache_hit_failure_short", "cache_expired_retry", "cache_miss", "force_refreshed")),
    )


# histories


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as revision from events")
def history_revisions(spark, d):
    return runs.revisions(table(spark, d, "events"), "user_id", "ts", ["event_id"]).select("event_id", "user_id", "revision")


@query("""
with r as (select user_id, max(case when event_type = 'signup' then cast(floor(value) as bigint) else 0 end) as explicit, cast(sum(case when event_type = 'click' and value > 95 then 7 else 0 end) as bigint) as timing, bool_or(event_type = 'purchase') as terminal, min(ts) as a, max(ts) as b from events group by 1)
select user_id, case when explicit > 90 then explicit when timing <> 0 then timing when terminal then epoch_ms(b) - epoch_ms(a) else 0 end as duration_ms from r""")
def run_durations(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    r = table(spark, d, "events").groupBy("user_id").agg(
        F.max(F.when(kind == "signup", value.cast("long")).otherwise(0)).alias("explicit"), F.sum(F.when((kind == "click") & (value > 95), 7).otherwise(0)).alias("timing"), F.bool_or(kind == "purchase").alias("terminal"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    return r.select("user_id", runs.duration_ms(F.when(F.col("explicit") > 90, F.col("explicit")), [F.col("timing")], F.col("terminal"), F.col("a"), F.col("b")).alias("duration_ms"))


_RUN_SQL = """r as (select user_id, case arg_max(event_type, (ts, event_id)) when 'purchase' then 'finished' when 'error' then 'failed' when 'signup' then 'needs_manual_review' else 'running' end as status, max(value) > 90 as deliverable, min(value) > 5 as passed,
 bool_or(event_type = 'signup') as manual, case when count(*) filter (event_type = 'error') > 1 then 'needs_manual_review' else 'deliverable' end as gate, max(ts) as seen from events group by 1)"""


def _runs(spark, d):
    kind, last = F.col("event_type"), F.max_by("event_type", F.struct("ts", "event_id"))
    r = table(spark, d, "events").groupBy("user_id").agg(
        last.alias("last"), (F.max("value") > 90).alias("deliverable"), (F.min("value") > 5).alias("passed"), F.bool_or(kind == "signup").alias("manual"), F.when(F.count_if(kind == "error") > 1, "needs_manual_review").otherwise("deliverable").alias("gate"), F.max("ts").alias("seen")
    )
    return r.withColumn("status", F.when(F.col("last") == "purchase", "finished").when(F.col("last") == "error", "failed").when(F.col("last") == "signup", "needs_manual_review").otherwise("running"))


@query(f"""
with {_RUN_SQL}, q as (select *, case when status = 'running' then 'pending' when deliverable and passed then 'passed' when manual or gate = 'needs_manual_review' then 'needs_manual_review' else 'failed' end as in_history,
 case when status = 'running' then 'pending' when deliverable and passed then 'passed' when manual then 'needs_manual_review' else 'failed' end as in_evaluation from r)
select user_id, status, in_history, in_evaluation from q""")
def quality_states(spark, d):
    c = F.col
    known = c("status"), c("deliverable"), c("passed"), c("manual")
    return _runs(spark, d).select("user_id", "status", runs.history_quality(*known, c("gate")).alias("in_history"), runs.run_quality(*known).alias("in_evaluation"))


@query(f"""
with {_RUN_SQL}, h as (select user_id, case when deliverable and passed then 'finished' else status end as status, deliverable, passed, coalesce(manual, false) and not passed as manual, gate from r)
select r.user_id, r.status = h.status and r.manual = h.manual as consistent, array_to_string(list_filter([case when r.status <> h.status then 'status' end, case when r.manual <> h.manual then 'manual' end], lambda x: x is not null), ',') as mismatches from r join h using (user_id)""")
def run_history_consistency(spark, d):
    r = _runs(spark, d)
    h = r.select("user_id", F.when(F.col("deliverable") & F.col("passed"), "finished").otherwise(F.col("status")).alias("status"), "deliverable", "passed", (F.col("manual") & ~F.col("passed")).alias("manual"), "gate")
    return runs.consistency(r, h, "user_id", ["status", "deliverable", "passed", "manual", "gate"])


@query(f"""
with {_RUN_SQL}, n as (select max(ts) as now from events) select user_id, case when status = 'running' and epoch_ms(now) - epoch_ms(seen) > 86400000 then 'failed' else status end as status, status = 'running' and epoch_ms(now) - epoch_ms(seen) > 86400000 as timed_out from r, n""")
def watchdog(spark, d):
    return runs.timed_out(_runs(spark, d), "user_id", "seen", F.col("status"), _now(table(spark, d, "events")), 86_400)


_STEPS = ("view", "click", "signup", "purchase", "error")


@query(f"""
with l as (select user_id, event_type as step, case when arg_max(value, (ts, event_id)) > 30 then 'completed' else 'started' end as status from events group by 1, 2),
h as (select user_id, coalesce(list(step) filter (status = 'completed'), []) as done, bool_or(step = 'signup' and status = 'started') as blocked from l group by 1),
s as (select *, list_filter([{quoted(_STEPS)}], lambda x: list_contains(done, x)) as skipped, list_filter([{quoted(_STEPS)}], lambda x: not list_contains(done, x)) as rest, list_filter(['view', 'click'], lambda x: list_contains(done, x)) as early from h)
select user_id, blocked, case when blocked then 'outcome_unknown' else '' end as error, coalesce(case when blocked then early[-1] else skipped[-1] end, '') as resumed_from, case when blocked then '' else coalesce(rest[1], '') end as next_step, array_to_string(skipped, ',') as skipped from s""")
def checkpoint_plan(spark, d):
    status = F.when(F.col("value") > 30, "completed").otherwise("started")
    return runs.checkpoint_plan(table(spark, d, "events"), "user_id", "event_type", status, ["ts", "event_id"], _STEPS, "signup")


@query("""
with o as (select role, o_orderkey from (select 'primary' as role, o_orderkey from orders where o_orderstatus = 'O' union all select 'auxiliary', l_orderkey from lineitem where l_returnflag = 'R')) select role, o_orderkey from o group by 1, 2""")
def material_identities(spark, d):
    primary = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return runs.identities(primary, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""
with b as (select o_orderkey, 0 as r, o_orderdate as pos from orders where o_orderstatus = 'O' union all select l_orderkey, 1, l_shipdate from lineitem where l_returnflag = 'R')
select o_orderkey, case when min(r) = 0 then 'primary' else 'auxiliary' end as role, min((r, pos))[2] as "at" from b group by 1""")
def ordered_keys(spark, d):
    primary = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderdate").alias("at"))
    return runs.ordered_union(primary, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at")), "o_orderkey", "at")


_LAYERS, _CODES = ("view", "click", "signup", "purchase", "error"), {"view": ("LATE", "SMALL"), "purchase": ("SMALL", "LATE")}


@query(f"""
with s as (select user_id, event_type as layer, case when value > 60 then 'blocked' when value > 20 then 'ok' else 'skipped' end as status, case when value > 90 then 'SMALL' when value > 75 then 'LATE' when value > 65 then 'X' else '' end as code from events),
c as (select *, case status when 'blocked' then 0 when 'ok' then 1 else 2 end as r, case when status <> 'blocked' then 1000 when layer = 'view' then case code when 'LATE' then 0 when 'SMALL' then 1 else 1000 end when layer = 'purchase' then case code when 'SMALL' then 0 when 'LATE' then 1 else 1000 end else 1000 end as cr,
 case when status <> 'blocked' then '' when code = '' then 'UNCLASSIFIED' when code = 'X' then 'UNKNOWN' else code end as n from s),
b as (select user_id, layer, min((r, cr, n)) as x from c group by 1, 2), k as (select user_id, list_sort(list((list_position([{quoted(_LAYERS)}], layer), layer, x[3])) filter (x[1] = 0)) as b from b group by 1)
select user_id, coalesce(b[1][2], '') as primary_layer, coalesce(b[1][3], '') as primary_code, coalesce(array_to_string(list_filter(list_transform(b[2:], lambda y: y[3]), lambda z: z <> b[1][3]), ','), '') as secondary from k""")
def layer_attribution(spark, d):
    v = F.col("value")
    stages = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("layer"), F.when(v > 60, "blocked").when(v > 20, "ok").otherwise("skipped").alias("status"), F.when(v > 90, "SMALL").when(v > 75, "LATE").when(v > 65, "X").otherwise("").alias("code")
    )
    return runs.attribution(stages, "user_id", _LAYERS, _CODES, {"X": "UNKNOWN"})


@query("""
with o as (select user_id, event_type as field, cast(floor(value) as bigint) as v, case when value > 97 then 'collection_failed' when value > 20 then 'observed' else 'not_observed' end as status from events),
a as (select user_id, field, v, status from o union all select user_id, case field when 'view' then 'click' else 'view' end, v, status from o where field in ('view', 'click'))
select user_id, field, case when not bool_or(status = 'collection_failed') then max(v) filter (status = 'observed') end as v, case when bool_or(status = 'collection_failed') then 'collection_failed' when max(v) filter (status = 'observed') is null then 'not_observed' else 'observed' end as status from a group by 1, 2""")
def merged_timings(spark, d):
    v = F.col("value")
    seen = table(spark, d, "events").select("user_id", F.col("event_type").alias("field"), v.cast("long").alias("v"), F.when(v > 97, "collection_failed").when(v > 20, "observed").otherwise("not_observed").alias("status"))
    return runs.merged_timings(seen, "user_id", "field", "v", "status", [("view", "click")])


@query("""
with r as (select user_id, count(*) as steps, cast(sum(coalesce(cast(props ->> '$.k' as bigint), 0)) as bigint) as tokens, max(ts) as seen from events group by 1 order by seen desc, user_id desc limit 50)
select r.user_id, steps, tokens, event_type as node, count(*) as n, cast(sum(coalesce(cast(props ->> '$.k' as bigint), 0)) as bigint) as node_tokens, round(sum(value), 4) as node_seconds from r join events e on e.user_id = r.user_id group by all""")
def latest_work(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    events = table(spark, d, "events")
    totals = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(k).alias("tokens"), F.max("ts").alias("seen")).orderBy(F.desc("seen"), F.desc("user_id")).limit(50)
    nodes = events.join(F.broadcast(totals), "user_id")  # 50 rows
    return nodes.groupBy("user_id", "steps", "tokens", F.col("event_type").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("node_tokens"), F.round(F.sum("value"), 4).alias("node_seconds"))


# caches


@query(f"""
with n as (select max(ts) as now from events), c as (select user_id, ts, {_SQL_STATUS} as status, cast(value / 25 as bigint) as failures from events), l as (select user_id, max((ts, failures, status)) as x from c group by 1),
s as (select user_id, x[3] as status, epoch(now) - epoch(x[1]) as age, case when x[3] = 'download_failed' then case when x[2] >= 3 then 7200 else 600 end else 2592000 end as ttl from l, n)
select user_id, status, case when floor(age) > ttl then 'cache_expired_retry' when status = 'download_failed' then 'cache_hit_failure_short' else 'cache_hit_success' end as state from s""")
def cache_states(spark, d):
    return _cache(spark, d).select("user_id", "status", "state")


def _cache(spark, d):
    events = table(spark, d, "events")
    rows = events.select("user_id", "ts", F.rint(F.col("value") / 25).cast("long").alias("failures"), _status().alias("status"))
    return caches.states(rows, "user_id", "ts", "status", "failures", _now(events))


def _now(events):
    """The latest time of the events, as a literal."""
    return F.timestamp_micros(F.lit(events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("n")).first()["n"]).cast("long"))


@query(f"""
with n as (select max(ts) as now from events), c as (select user_id, ts, {_SQL_STATUS} as status, cast(value / 25 as bigint) as failures from events), l as (select user_id, max((ts, failures, status)) as x from c group by 1),
s as (select user_id, floor(epoch(now) - epoch(x[1])) > case when x[3] = 'download_failed' then case when x[2] >= 3 then 7200 else 600 end else 2592000 end as expired from l, n)
select c_custkey as user_id from customer where c_custkey not in (select user_id from s where not expired)""")
def cache_work(spark, d):
    return caches.work(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _cache(spark, d), "user_id")


@query("""
with p as (select sha256(text) as pack, min(length(text)) as chars from documents group by 1), c as (select pack from (select sha256(text) as pack, length(text) as chars from documents where lang = 'en') where chars <= 3000 group by 1)
select pack, chars, pack in (select pack from c) as hit from p""")
def compact_cache(spark, d):
    packs = table(spark, d, "documents").select(F.sha2("text", 256).alias("pack"), F.length("text").cast("long").alias("chars"), "lang")
    cached = packs.where("lang = 'en'").select("pack", "chars")
    return caches.get_or_compute(packs, cached, "pack", "chars", "chars", lambda rows: rows.groupBy("pack").agg(F.min("chars").alias("chars")), most=3000)


@query(f"""
with n as (select max(ts) as now from events), c as (select event_id, user_id, ts, {_SQL_STATUS} as status, cast(value / 25 as bigint) as failures from events)
select event_id, user_id, status from c, n where floor(epoch(now) - epoch(ts)) <= case when status = 'download_failed' then case when failures >= 3 then 7200 else 600 end else 1728000 + 864000 end""")
def cache_cleanup(spark, d):
    events = table(spark, d, "events")
    rows = events.select("event_id", "user_id", "ts", F.rint(F.col("value") / 25).cast("long").alias("failures"), _status().alias("status"))
    return caches.cleaned(rows, "ts", "status", "failures", _now(events)).select("event_id", "user_id", "status")


# budgets


def _items(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return t.select("source", "doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("mandatory"), (level * 1_000_000_000 + F.col("doc_id")).alias("priority"), text.json_chars({"id": F.col("doc_id"), "quote": F.substring("text", 1, 500)}).alias("chars"))


@query("""
with i as (select source, d.doc_id, coalesce(toxic = 1, false) as mandatory, case quality when 1 then 0 when 0 then 1 else 2 end as lvl, length(to_json({'id': d.doc_id, 'quote': left(text, 500)})) + 3 as chars from documents d left join labels l on l.doc_id = d.doc_id),
f as (select source, sum(case when mandatory then chars + 2 else 0 end) as fixed from i group by 1), o as (select *, sum(chars + 2) over (partition by source order by lvl, doc_id rows unbounded preceding) as running from i where not mandatory)
select source, doc_id, chars, mandatory, case when mandatory then 0 else cast(running as bigint) end as running, mandatory or running + fixed + 200 <= 20000 as kept from (select source, doc_id, chars, mandatory, running from o union all select source, doc_id, chars, mandatory, 0 from i where mandatory) join f using (source)""")
def optional_evidence(spark, d):
    found = budgets.optional_evidence(_items(spark, d), "source", F.col("mandatory"), "priority", ["doc_id"], "chars", 20_000, 200)
    return found.select("source", "doc_id", "chars", "mandatory", "running", "kept")


@query("""
with s as (select source, doc_id, length(text) as n, greatest(length(text) - 120, 0) as room from documents), t as (select source, sum(n) - 40000 as excess from s group by 1), r as (select *, sum(room) over (partition by source order by n desc, doc_id rows unbounded preceding) as running from s)
select source, doc_id, n as chars, cast(n - least(room, greatest(excess - (running - room), 0)) as bigint) as chars_left from r join t using (source)""")
def trimmed_strings(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("chars"))
    return budgets.trimmed(rows, "source", "doc_id", "chars", 40_000, 120).withColumnRenamed("left", "chars_left")


@query("""
with p as (select doc_id, i as page_no, s as page, sum(length(s)) over (partition by doc_id order by i rows unbounded preceding) as so_far from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, regexp_split_to_array(text, '\\n') as a from documents)) where i <= 120)
select doc_id, page_no, so_far, case when length(page) < 20 then 'empty' else 'parsed' end as status, length(page) < 20 as ocr from p where so_far - length(page) < 6000""")
def page_cut(spark, d):
    """Lines as pages: at most 120 of them, until 6,000 characters are reached; short ones would be read by other means."""
    from pyspark.sql import Window

    from evidra.operators.predicates import ocr_candidate

    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 120)).alias("i", "page")).withColumn("n", F.length("page"))
    told = pages.withColumn("so_far", F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    scanned = ocr_candidate(F.lit(True), F.col("n"), F.lit(True), 20)
    return told.where("so_far - n < 6000").select("doc_id", (F.col("i") + 1).cast("long").alias("page_no"), "so_far", F.when(scanned, "empty").otherwise("parsed").alias("status"), scanned.alias("ocr"))


# evaluation


@query("""
select count(*) as sample_count, count(distinct source) as case_count, count(*) filter (quality = 1) as passed_count, count(*) filter (quality <> 1) as failed_count, count(*) filter (toxic = 1) as forbidden_count, count(*) filter (n_chars <> length(text)) as contradiction_count,
 count(*) filter (lang = '') as missing_id_count, count(*) filter (text <> '') as hash_complete_count, count(*) filter (quality is not null and toxic is not null) as metrics_complete_count, count(*) filter (n_chars = length(text)) as replayable_count,
 cast(coalesce(sum(n_chars), 0) as bigint) as chars, min(n_chars) as n_chars_min, max(n_chars) as n_chars_max, round(avg(n_chars), 3) as n_chars_mean, quantile_disc(seconds, 0.5) as seconds_p50, quantile_disc(seconds, 0.95) as seconds_p95
from (select *, n_chars / 100.0 as seconds from documents join labels using (doc_id))""")
def metric_summary(spark, d):
    return _summary(spark, d)


def _summary(spark, d, lang=None):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("seconds", F.col("n_chars") / 100)
    rows = rows.where(F.col("lang") == lang) if lang else rows
    whole = F.col("n_chars") == F.length("text")
    flags = {
        "passed_count": F.col("quality") == 1, "failed_count": F.col("quality") != 1, "forbidden_count": F.col("toxic") == 1, "contradiction_count": ~whole, "missing_id_count": F.col("lang") == "", "hash_complete_count": F.col("text") != "",
        "metrics_complete_count": F.col("quality").isNotNull() & F.col("toxic").isNotNull(), "replayable_count": whole,
    }
    out = evaluate.summary(rows, "source", flags, {"chars": F.col("n_chars")}, "n_chars", "seconds")
    if lang is None:
        return out
    left_out = rows.where("quality is null").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("excluded"))  # cases, not samples
    return out.join(left_out)


_SQL_SIDE = "select count(*) as n, count(*) filter (quality <> 1) as failed, count(*) filter (toxic = 1) as forbidden, count(*) filter (quality = 1) as passed, count(*) filter (text <> '') as hashes, quantile_disc(n_chars / 100.0, 0.95) as p95 from documents join labels using (doc_id) where lang"


@query(f"""
with c as ({_SQL_SIDE} = 'en'), b as ({_SQL_SIDE} = 'fr')
select c.failed = 0 as holds_failed_count, c.forbidden = 0 as holds_forbidden_count, true as holds_contradiction_count, true as holds_missing_id_count, c.hashes = c.n as holds_hash_complete_count, true as holds_metrics_complete_count, true as holds_replayable_count, true as holds_excluded,
 c.passed - b.passed as delta_passed_count, c.forbidden - b.forbidden as delta_forbidden_count, round(greatest(1.3 * b.p95, b.p95 + 30), 3) as p95_limit, c.p95 <= greatest(1.3 * b.p95, b.p95 + 30) as p95_passed,
 c.failed = 0 and c.forbidden = 0 and c.hashes = c.n and c.p95 <= greatest(1.3 * b.p95, b.p95 + 30) as passed from c, b""")
def baseline_compare(spark, d):
    return evaluate.compared(_summary(spark, d, "en"), _summary(spark, d, "fr"), "seconds_p95", ["passed_count", "forbidden_count"], "excluded")


@query("""
with a as (select o_orderkey, sha256(to_json({'date': strftime(o_orderdate, '%Y-%m-%d'), 'status': o_orderstatus})) as h from orders where o_orderpriority <> '5-LOW'),
b as (select o_orderkey, sha256(to_json({'date': strftime(o_orderdate, '%Y-%m-%d'), 'status': case when o_totalprice > 300000 then 'X' else o_orderstatus end})) as h from orders where o_orderpriority <> '1-URGENT')
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.h is null then 'missing' when a.h is null then 'new' when a.h = b.h then 'same' else 'changed' end as state from a full join b on a.o_orderkey = b.o_orderkey""")
def frozen_records(spark, d):
    orders = table(spark, d, "orders")
    of = lambda rows, status: rows.select("o_orderkey", text.canonical_hash({"status": status, "date": F.date_format("o_orderdate", "yyyy-MM-dd")}).alias("h"))
    now = F.when(F.col("o_totalprice") > 300_000, "X").otherwise(F.col("o_orderstatus"))
    return evaluate.frozen_matches(of(orders.where("o_orderpriority <> '5-LOW'"), F.col("o_orderstatus")), of(orders.where("o_orderpriority <> '1-URGENT'"), now), "o_orderkey", "h")


@query("""
with s as (select user_id, count(*) as claims, count(*) filter (value > 10) as supported, count(*) filter (value <= 12) as unsupported, count(*) filter (event_type = 'error') as repairs, count(*) filter (value > 99) as new_facts from events group by 1)
select user_id, unnest(list_filter([case when supported + unsupported <> claims then 'claims_add_up' end, case when repairs > 1 then 'one_repair' end, case when unsupported > 0 then 'all_supported' end, case when new_facts > 0 then 'no_new_facts' end], lambda x: x is not null)) as violation from s""")
def metric_constraints(spark, d):
    v = F.col("value")
    s = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(v > 10).alias("supported"), F.count_if(v <= 12).alias("unsupported"), F.count_if(F.col("event_type") == "error").alias("repairs"), F.count_if(v > 99).alias("new_facts")
    )
    c = F.col
    rules = {"claims_add_up": c("supported") + c("unsupported") == c("claims"), "one_repair": c("repairs") <= 1, "all_supported": c("unsupported") == 0, "no_new_facts": c("new_facts") == 0}
    return evaluate.violated(s, "user_id", rules)


@query("""
with u as (select 1 as o_orderkey), a as (select * from orders where o_orderkey not in (select o_orderkey from u)), s1 as (select o_orderkey from a where o_totalprice > 300000 order by o_orderdate, o_orderkey limit 1),
s2 as (select o_orderkey from a where o_orderstatus = 'P' and o_orderkey not in (from s1) order by o_orderdate, o_orderkey limit 1), s3 as (select o_orderkey from a where o_orderkey not in (from s1) and o_orderkey not in (from s2) order by o_orderdate, o_orderkey limit 1)
select 'large' as stratum, o_orderkey from s1 union all select 'partial', o_orderkey from s2 union all select 'impossible', o_orderkey from s3""")
def stratified_cases(spark, d):
    orders = table(spark, d, "orders")
    wanted = {"large": F.col("o_totalprice") > 300_000, "partial": F.col("o_orderstatus") == "P", "impossible": F.col("o_totalprice") < 0}
    return evaluate.strata(orders, "o_orderkey", wanted, [F.col("o_orderdate")], spark.createDataFrame([(1,)], "o_orderkey long"))


@query("""
with v as (select user_id, ts, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as place from events) select user_id, place, ts, event_id, event_type from v where place <= 3""")
def item_versions(spark, d):
    return evaluate.versions(table(spark, d, "events"), "user_id", ["ts", "event_id", "event_type"], 3)


@query("""
with f as (select doc_id, case when length(text) > 2000 then 'A' when length(text) > 500 then 'B' else 'C' end as level, text as v from documents where lang in ('en', 'fr')),
c as (select doc_id, case when length(text) > 2000 then 'A' when length(text) > 500 then 'B' else 'C' end as level, case when contains(text, 'password') then replace(text, 'password', '*') else text end as v from documents where lang <> 'fr' or length(text) > 900),
x as (select coalesce(f.doc_id, c.doc_id) as doc_id, coalesce(f.level, c.level) as level, case when c.doc_id is null then 'lost' when f.doc_id is null then 'added' when f.v = c.v and f.level = c.level then 'supported' else 'changed' end as state from f full join c on f.doc_id = c.doc_id)
select level, count(*) filter (state <> 'lost') as held, count(*) filter (state = 'supported') as supported, count(*) filter (state = 'lost') as lost, coalesce(round(count(*) filter (state = 'supported') / nullif(count(*) filter (state <> 'lost'), 0), 6), 0.0) as rate from x group by 1""")
def artifact_support(spark, d):
    docs = table(spark, d, "documents")
    n = F.length("text")
    level = F.when(n > 2000, "A").when(n > 500, "B").otherwise("C")
    full = docs.where(F.col("lang").isin("en", "fr")).select("doc_id", level.alias("level"), F.col("text").alias("v"))
    compact = docs.where((F.col("lang") != "fr") | (n > 900)).select("doc_id", level.alias("level"), F.replace("text", F.lit("password"), F.lit("*")).alias("v"))
    found = facts.cross_supported(full, compact, "doc_id", ["level", "v"])
    held, yes = F.count_if(F.col("state") != "lost"), F.count_if(F.col("state") == "supported")
    return found.groupBy("level").agg(held.alias("held"), yes.alias("supported"), F.count_if(F.col("state") == "lost").alias("lost"), F.coalesce(F.round(yes / F.when(held > 0, held), 6), F.lit(0.0)).alias("rate"))


_KEYWORDS = ("STEEL", "Brand#11", "Brand#23", "SMALL", "1")


@query(f"""
with m as (select p_partkey, len(list_filter([{quoted(_KEYWORDS)}], lambda k: contains(p_type || ' ' || p_brand || ' ' || p_size, k))) as matched from part)
select p_partkey, matched, round(least(1.0, matched / 5.0), 3) as score, case when least(1.0, matched / 5.0) < 0.15 then 'low' else 'related' end as relation from m""")
def auxiliary_relation(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("title"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("content"))
    matched, score, relation = facts.relation(rows, list(_KEYWORDS), "title", "content")
    return rows.select("p_partkey", matched.alias("matched"), score.alias("score"), relation.alias("relation"))


@query("""
with o as (select c_custkey, count(*) filter (o_orderstatus = 'O') as primaries, count(*) filter (o_orderstatus <> 'O') as auxiliaries, max(o_totalprice) as most from customer left join orders on o_custkey = c_custkey group by 1),
l as (select o_custkey as c_custkey, count(*) as children, round(max(l_extendedprice), 2) as longest, string_agg(distinct l_returnflag, ',' order by l_returnflag) as kinds from orders join lineitem on l_orderkey = o_orderkey group by 1)
select c_custkey, primaries, auxiliaries, coalesce(children, 0) as children, longest, coalesce(kinds, '') as kinds, case when primaries = 0 then 'no_primary' when primaries > 3 then 'too_many_primary' when auxiliaries > 10 then 'too_many_auxiliary' else 'valid' end as selection from o left join l using (c_custkey)""")
def pack_assembly(spark, d):
    """A pack for each customer: its records by role, its children folded by kind, and whether the selection is one that may be prepared."""
    orders = table(spark, d, "orders")
    status = F.col("o_orderstatus")
    packs = table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count_if(status == "O").alias("primaries"), F.count_if(status != "O").alias("auxiliaries"))
    lines = table(spark, d, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",")
    children = lines.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("children"), F.round(F.max("l_extendedprice"), 2).alias("longest"), kinds.alias("kinds"))
    p, a = F.col("primaries"), F.col("auxiliaries")
    selection = F.when(p == 0, "no_primary").when(p > 3, "too_many_primary").when(a > 10, "too_many_auxiliary").otherwise("valid")
    return packs.join(children, "c_custkey", "left").select("c_custkey", "primaries", "auxiliaries", F.coalesce("children", F.lit(0)).alias("children"), "longest", F.coalesce("kinds", F.lit("")).alias("kinds"), selection.alias("selection"))
