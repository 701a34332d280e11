"""Queries over what is kept of evidence, summaries of tables, projections of runs, and checks of notices on procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import claims, evaluate, evidence, gates, grids, packs
from evidra.plans.catalog import budgeted_evidence
from evidra.plans.catalog_packs import _SQL_CUT, _SQL_FIELDS, _fields
from evidra.plans.catalog_tables import _KINDS, _SQL_KINDS
from evidra.plans.registry import query, quoted
from evidra.sources import table

_SQL_KEPT = "b as (select source, doc_id, length(text) > 4000 as mandatory, sum(length(text)) over (partition by source order by length(text) desc, doc_id rows unbounded preceding) <= 80000 as kept from documents)"


def _mandatory(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", (F.length("text") > 4000).alias("mandatory"))


@query(f"with {_SQL_KEPT} select source, doc_id from b where mandatory and not kept")
def missing_mandatory(spark, d):
    return evidence.missing_mandatory(_mandatory(spark, d), budgeted_evidence(spark, d), "source", "doc_id")


@query(f"""
with {_SQL_KEPT} select source, count(*) filter (mandatory) as total, count(*) filter (mandatory and kept) as retained, count(*) filter (mandatory and not kept) as missing,
 round_even(count(*) filter (mandatory and kept) / nullif(count(*) filter (mandatory), 0), 6) as rate, case when count(*) filter (mandatory) > 0 then 'measured' else 'not_applicable' end as status from b group by 1""")
def retention_status(spark, d):
    return evidence.retention_status(_mandatory(spark, d), budgeted_evidence(spark, d), "source", "doc_id")


@query(f"""
with {_SQL_FIELDS}, s as (select pack, role, material, attachment, field, i, text, 1 as s from f where attachment >= 0 and field in ('summary', 'key_facts') union all select pack, role, material, attachment, 'headers', i, split_part(text, ' ', 1), 1 from f where attachment >= 0 and field = 'sections'
 union all select pack, role, material, attachment, 'key_facts', i, text, 2 from f where attachment >= 0 and field in ('key_facts', 'sections')),
u as (select pack, role, material, attachment, field, text, min((s, i)) as pos from s where field = 'summary' or trim(text) <> '' group by 1, 2, 3, 4, 5, 6),
g as (select pack, role, material, attachment, coalesce(arg_max(text, (length(text), -pos[1], -pos[2])) filter (field = 'summary'), '') as text, coalesce(string_agg(text, chr(31) order by pos) filter (field = 'key_facts'), '') as facts, count(*) filter (field = 'key_facts') as n_facts,
 coalesce(string_agg(text, chr(31) order by pos) filter (field = 'headers'), '') as headers, 160 as n from u group by 1, 2, 3, 4)
select pack, role, cast(material as bigint) as material, cast(attachment as bigint) as attachment, {_SQL_CUT} as summary, n_facts, sha256(facts) as facts, sha256(headers) as headers from g""")
def attachment_catalog(spark, d):
    """What is kept of every attachment: facts of the attachment and of its summary united, headers, the longest summary shortened."""
    rows = _fields(spark, d).drop("lang").where("attachment >= 0")
    own = rows.where(F.col("field") != "sections").withColumn("source", F.lit("attachment"))
    heads = rows.where("field = 'sections'").withColumns({"field": F.lit("headers"), "text": F.split("text", " ")[0], "source": F.lit("attachment")})
    again = rows.where(F.col("field") != "summary").withColumns({"field": F.lit("key_facts"), "source": F.lit("summary")})
    out = packs.fidelity_catalog(own.unionByName(heads).unionByName(again), ("attachment", "summary"))
    told = lambda c: F.sha2(F.array_join(c, "\x1f"), 256)
    return out.select("pack", "role", F.col("material").cast("long").alias("material"), F.col("attachment").cast("long").alias("attachment"), "summary", F.size("key_facts").cast("long").alias("n_facts"), told("key_facts").alias("facts"), told("table_headers").alias("headers"))


_COLUMNS = ("p_name", "p_type", "p_size", "p_retailprice", "p_partkey")


@query(f"""
with c as (select p_brand, p_partkey as r, unnest([1, 2, 3, 4, 5]) as p, unnest([{quoted(_COLUMNS)}]) as h, unnest([p_name, case when p_size % 9 = 0 then ' ' else p_type end, cast(p_size as varchar), format('{{:.2f}}', p_retailprice), cast(p_partkey as varchar)]) as v from part),
k as (select unnest([{_SQL_KINDS}], recursive := true)), t as (select p_brand, kind, r, p, trim(v) as v, case when kind in ('price', 'quantity') then cast(v as double) end as x from c, k where len(list_filter(words, lambda w: contains(lower(h), w))) > 0 and trim(v) <> ''),
u as (select p_brand, kind, v, count(*) as n, min((r, p)) as pos, min(x) as x from t group by 1, 2, 3), s as (select p_brand, kind, sum(n) as filled, count(*) as different, min(x) as least, max(x) as most from u group by 1, 2),
f as (select p_brand, kind, string_agg(v, '|' order by pos) as samples from (select * from u qualify row_number() over (partition by p_brand, kind order by pos) <= 5) group by 1, 2),
m as (select p_brand, kind, string_agg(cast(cast(floor(x) as bigint) as varchar), '|' order by r, p) as numbers from (select * from t where x is not null qualify row_number() over (partition by p_brand, kind order by r, p) <= 5) group by 1, 2),
j as (select p_brand, string_agg(kind || ':' || filled || ':' || different || ':' || samples || ':' || coalesce(cast(cast(floor(least) as bigint) as varchar), '') || ':' || coalesce(cast(cast(floor(most) as bigint) as varchar), '') || ':' || coalesce(numbers, ''), ';' order by kind) as profile from s join f using (p_brand, kind) left join m using (p_brand, kind) group by 1)
select p_brand, count(distinct r) as n_rows, count(distinct p) as n_columns, '{",".join(_COLUMNS)}' as headers, any_value(profile) as profile from c join j using (p_brand) group by 1""")
def table_profiles(spark, d):
    """A summary of each brand's table of parts, with a profile of every kind of column."""
    said = F.array(F.col("p_name"), F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_type")), F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice"), F.col("p_partkey").cast("string"))
    cells = table(spark, d, "part").select("p_brand", "p_partkey", F.posexplode(F.arrays_zip(F.array(*map(F.lit, _COLUMNS)).alias("h"), said.alias("v"))).alias("p", "x")).select("p_brand", "p_partkey", "p", "x.*")
    out = grids.table_profiles(cells, "p_brand", "p_partkey", "p", "h", "v", _KINDS, ("price", "quantity"))
    whole = lambda c: F.coalesce(F.floor(c).cast("string"), F.lit(""))
    one = lambda x: F.concat_ws(":", x["kind"], x["non_empty"].cast("string"), x["different"].cast("string"), F.array_join(x["samples"], "|"), whole(x["least"]), whole(x["most"]), F.array_join(F.transform(x["numbers"], lambda n: F.floor(n).cast("string")), "|"))
    return out.select("p_brand", "n_rows", "n_columns", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("profile", one), ";").alias("profile"))


@query("""
with r as (select user_id, case when max(value) > 90 then 'deliverable' when max(value) < 40 then 'needs_manual_review' else '' end as gate, list_sort(list_distinct(list(upper(event_type)) filter (value > 70))) as codes,
 case arg_max(event_type, (ts, event_id)) when 'error' then 'failed' when 'signup' then 'needs_manual_review' else 'finished' end as own, case when bool_or(event_type = 'error' and value > 60) then 'ERROR' else '' end as error,
 case when count(*) % 3 > 0 then cast(floor(max(value)) as bigint) end as fidelity, case when count(*) % 2 = 0 then count(*) end as depth from events group by 1),
c as (select *, case when gate = '' and own = 'failed' then ['RUN_FAILED', 'DIAGNOSTICS_UNAVAILABLE'] else coalesce(codes, []) end as k from r)
select user_id, case when gate <> '' then gate when own in ('failed', 'needs_manual_review') then own else '' end as deliverable_status, array_to_string(case when error <> '' and not list_contains(k, error) then list_append(k, error) else k end, ',') as blocking_codes,
 coalesce(fidelity, case when error <> '' then 0 end) as fidelity, coalesce(depth, case when error <> '' then 0 end) as depth from c""")
def evaluation_projection(spark, d):
    """What an evaluation keeps of runs, folded from their events."""
    kind, value = F.col("event_type"), F.col("value")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    runs = table(spark, d, "events").groupBy("user_id").agg(
        F.when(F.max(value) > 90, "deliverable").when(F.max(value) < 40, "needs_manual_review").otherwise("").alias("gate_status"), F.sort_array(F.collect_set(F.when(value > 70, F.upper(kind)))).alias("gate_codes"),
        F.when(last == "error", "failed").when(last == "signup", "needs_manual_review").otherwise("finished").alias("run_status"), F.when(F.coalesce(F.bool_or((kind == "error") & (value > 60)), F.lit(False)), "ERROR").otherwise("").alias("error_code"),
        F.when(F.count(F.lit(1)) % 3 > 0, F.floor(F.max(value))).alias("fidelity"), F.when(F.count(F.lit(1)) % 2 == 0, F.count(F.lit(1))).alias("depth"),
    )
    out = evaluate.projected(runs, "user_id", ("fidelity", "depth"))
    return out.withColumn("blocking_codes", F.array_join("blocking_codes", ","))


_TOPICS = (("licence", ("Licensed", "license")), ("secret", ("password", "token")), ("the", ("the",)))
_SQL_MISSING = ", ".join(f"case when len(list_filter([{quoted(w)}], lambda k: contains(c, k))) = 0 then '{t}' end" for t, w in _TOPICS)


@query(f"""
with t as (select doc_id, regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as c, len(regexp_split_to_array(text, '\\n+')) as sections from documents),
p as (select * from t where len(list_filter(['the', 'que'], lambda k: contains(c, k))) >= 1 and len(list_filter(['on', 'er', 'qz'], lambda k: contains(c, k))) >= 2),
m as (select *, list_filter([{_SQL_MISSING}], lambda x: x is not null) as missing from p)
select doc_id, array_to_string(missing, ',') as missing, sections < 3 or len(missing) > 0 as shallow from m""")
def process_reports(spark, d):
    """Reports on changed procedures: the topics that they lack, and whether they are too shallow."""
    rows = table(spark, d, "documents").withColumn("c", F.regexp_replace("text", "\\s+", "")).where(gates.process_notice(F.col("c"), ("the", "que"), ("on", "er", "qz")))
    found = rows.select("doc_id", gates.process_depth(F.col("c"), F.size(F.split("text", "\n+")), _TOPICS).alias("x"))
    return found.select("doc_id", F.array_join("x.missing", ",").alias("missing"), F.col("x.shallow").alias("shallow"))


@query("""
select p_partkey, array_to_string(list_sort(list_distinct(list_filter([ '202' || p_size % 10 || '年' || (p_size % 12 + 1) || '月' || (p_size % 28 + 1) || '日', (p_size % 28 + 1) || '日', p_size || '年', (p_partkey % 90 + 10) || '万元', case when p_size % 2 = 0 then '上海市' end, case when p_size % 2 = 0 then '上海市医保局' end, case when p_size % 2 = 0 then '医保局' end], lambda x: x is not null))), '|') as markers from part""")
def hard_markers(spark, d):
    """Dates, amounts, regions and offices in sentences made of each part."""
    c = F.col
    said = F.concat(F.lit("自 202"), c("p_size") % 10, F.lit("年"), c("p_size") % 12 + 1, F.lit("月"), c("p_size") % 28 + 1, F.lit("日 起, 周期 "), c("p_size"), F.lit("年, 金额 "), c("p_partkey") % 90 + 10, F.lit("万元 "), F.when(c("p_size") % 2 == 0, " 上海市医保局").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(claims.hard_markers(said)), "|").alias("markers"))
