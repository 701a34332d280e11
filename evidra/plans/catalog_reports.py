"""Queries over reports, facts, gates and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import text
from evidra.operators import facts, gates, markdown
from evidra.plans.registry import query, quoted
from evidra.sources import table


def _reports(spark, d):
    """A report for each part, as Markdown: title, lead, a section with a table, a fence, and another section for large ones."""
    s = lambda *x: F.concat(*[F.lit(y) if not y.startswith("p_") else F.col(y).cast("string") for y in x])
    body = F.concat(
        s("# Report on ", "p_name", "\n\n", "p_name", " is made by ", "p_brand", "; it has size ", "p_size", ".\n\n## Facts\n\n| Name | Size |\n| --- | --- |\n| ", "p_name", " | ", "p_size", " |\n| second row of it | ", "p_size", "0 |\n\n```\nnot a claim of "),
        s("p_name", "\n```\n"), F.when(F.col("p_size") > 25, s("## Risks\n\n- Risk of ", "p_type", " is 10.5% of all; see ", "p_brand", "\n")).otherwise(F.lit("")),
    )
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", body.alias("markdown"))


_C = "trim(x, '。！？!?；;，,：:|*-_`> ')"


@query(f"""
with c as (select p_partkey, 'line[2].sentence[0]' as location, p_name || ' is made by ' || p_brand as x from part union all select p_partkey, 'line[2].sentence[1]', 'it has size ' || p_size || '.' from part
 union all select p_partkey, 'table[0].row[0]', 'Name: ' || p_name || ' | Size: ' || p_size from part union all select p_partkey, 'table[0].row[1]', 'Name: second row of it | Size: ' || p_size || '0' from part
 union all select p_partkey, 'line[16].sentence[0]', 'Risk of ' || p_type || ' is 10.5% of all' from part where p_size > 25 union all select p_partkey, 'line[16].sentence[1]', 'see ' || p_brand from part where p_size > 25),
n as (select p_partkey, location, {_C} as claim from c)
select p_partkey, location, claim, sha256('claim-1' || chr(10) || replace(claim, ' ', '')) as claim_id, location as locations from n where length(replace(claim, ' ', '')) >= 9""")
def claim_extract(spark, d):
    return markdown.claims_of(markdown.lines(_reports(spark, d), "p_partkey", "markdown"), "p_partkey")


@query("""
select p_partkey, 1 as lead_paragraphs, case when p_size > 25 then 2 else 1 end as meaningful_sections, 1 as tables, 2 as table_rows from part""")
def report_metrics(spark, d):
    return markdown.report_metrics(markdown.parts_of(markdown.lines(_reports(spark, d), "p_partkey", "markdown"), "p_partkey"), "p_partkey")


@query("""
select p_partkey, 'title' as part, 0 as section_no, 0 as place, 'Report on ' || p_name as text from part union all select p_partkey, 'lead', 0, 2, p_name || ' is made by ' || p_brand || '; it has size ' || p_size || '.' from part
union all select p_partkey, 'section', 1, 4, 'Facts' from part union all select p_partkey, 'table', 1, 6, 'Name | Size' from part union all select p_partkey, 'row', 1, 8, p_name || ' | ' || p_size from part
union all select p_partkey, 'row', 1, 9, 'second row of it | ' || p_size || '0' from part union all select p_partkey, 'section', 2, 14, 'Risks' from part where p_size > 25
union all select p_partkey, 'paragraph', 2, 16, 'Risk of ' || p_type || ' is 10.5% of all; see ' || p_brand from part where p_size > 25""")
def report_parts(spark, d):
    return markdown.parts_of(markdown.lines(_reports(spark, d), "p_partkey", "markdown"), "p_partkey")


@query("""
with t as (select *, 'Report on ' || p_name as title from part)
select p_partkey, 'no_title' as issue, title as detail from t where length(title) < 30 union all select p_partkey, 'informal_words', 'row of it' from t
union all select p_partkey, 'blocked_words', 'steel' from t where p_size > 25 and contains(p_type, 'STEEL')""")
def structural_issues(spark, d):
    parts = markdown.parts_of(markdown.lines(_reports(spark, d), "p_partkey", "markdown"), "p_partkey")
    return markdown.structural_issues(parts, "p_partkey", informal=("row of it", "obviously"), blocked=("steel",), least_title=30)


@query("""
select p_partkey, 8 as place, cast(p_size as varchar) as marker from part where p_size % 3 = 0 union all select p_partkey, 9, p_size || '0' from part""")
def cells_without_evidence(spark, d):
    reports = _reports(spark, d)
    evidence = reports.select("p_partkey", F.explode(F.array(F.concat("p_name", F.lit(" of size "), F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("p_size").cast("string"))), F.concat(F.lit("another of "), F.col("p_size"), F.lit("0")))).alias("line"))
    return markdown.cells_without_evidence(markdown.parts_of(markdown.lines(reports, "p_partkey", "markdown"), "p_partkey"), "p_partkey", evidence, "[0-9]+(?:\\.[0-9]+)?")


def _talks(spark, d):
    """Conversations as reports (what the assistant says) with their evidence (what the user says) and the evidence of the one before."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("t"))
    of = lambda role, name: turns.where(F.col("role") == role).select("conv_id", F.col("t").alias(name))
    return of("assistant", "report").join(of("user", "evidence"), "conv_id")


_SQL_TALKS = """s as (select conv_id, role, string_agg(text, chr(10) order by turn) as t from conversations group by 1, 2),
t as (select a.conv_id, a.t as report, u.t as evidence from s a join s u on a.conv_id = u.conv_id where a.role = 'assistant' and u.role = 'user')"""
_WORDS, _GROUNDS, _MARKER = ("the", "and", "que", "der"), ("th", "er", "on", "en"), "[A-Z][a-z]{3,}"


@query(f"""
with {_SQL_TALKS}, p as (select conv_id, regexp_replace(evidence, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as ev, list_filter(list_transform(regexp_split_to_array(report, '[。！？!?；;.\\n]+'), lambda s: trim(s)), lambda s: len(list_filter([{quoted(_WORDS)}], lambda w: contains(s, w))) > 0) as s,
 len(regexp_extract_all(report, 'Analys[a-z]+')) as h from t),
b as (select conv_id, len(s) as n, h, len(list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, '{_MARKER}'), lambda m: not contains(ev, m))) = 0 and len(list_filter([{quoted(_GROUNDS)}], lambda g: contains(x, g) and contains(ev, g))) > 0)) as k from p)
select conv_id, cast(least(100, 25 * k + 10 * least(n, 3) + 15 * h) as bigint) as score, n as analysing, k as backed, k < 2 or least(100, 25 * k + 10 * least(n, 3) + 15 * h) < 50 as summary_only from b""")
def analysis_depth(spark, d):
    return markdown.analysis_depth(_talks(spark, d), "conv_id", "report", "evidence", _WORDS, _GROUNDS, _MARKER, "Analys[a-z]+")


_CORE = "[A-Z][a-z]{11,}"


@query(f"""
with {_SQL_TALKS}, p as (select conv_id, report, evidence, regexp_replace(evidence, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as ev, regexp_replace(report, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as re, list_filter(list_transform(regexp_split_to_array(report, '[。！？!?；;.\\n]+'), lambda s: trim(s)), lambda s: len(list_filter([{quoted(_WORDS)}], lambda w: contains(s, w))) > 0) as s from t),
b as (select *, len(s) as n, len(list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, '{_MARKER}'), lambda m: not contains(ev, m))) = 0 and len(list_filter([{quoted(_GROUNDS)}], lambda g: contains(x, g) and contains(ev, g))) > 0)) as k,
 len(list_filter(list_distinct(regexp_extract_all(report, '{_CORE}')), lambda m: not contains(ev, m))) as bad, len(list_filter(list_distinct(regexp_extract_all(evidence, '{_CORE}')), lambda m: not contains(re, m))) > 0 as lost, contains(report, 'Licensed') as note from p),
g as (select *, list_filter([case when bad > 0 then 'unsupported_fact' end, case when k < 2 or least(100, 25 * k + 10 * least(n, 3)) < 50 then 'summary_only' end, case when lost then 'core_missing' end, case when note then 'technical_note' end], lambda x: x is not null) as i from b)
select conv_id, case when ev = '' then 100 else cast(greatest(0, 100 - 25 * bad - case when note then 20 else 0 end) as bigint) end as fidelity, case when ev = '' then 0 else bad end as unsupported, case when ev <> '' then array_to_string(i, ',') when re <> '' then 'no_evidence' else '' end as issues,
 case when re = '' then 'failed' when ev = '' or len(i) > 0 then 'needs_manual_review' else 'deliverable' end as verdict, ev <> '' as evidence_present from g""")
def local_gate(spark, d):
    talks = _talks(spark, d)
    depth = markdown.analysis_depth(talks, "conv_id", "report", "evidence", _WORDS, _GROUNDS, _MARKER, "#none#")
    return gates.local_gate(talks, "conv_id", "report", "evidence", F.lit(False), F.lit(False), _CORE, _CORE, ("Licensed",), depth)


@query(f"""
with {_SQL_TALKS}, h as (select t.*, o.evidence as history from t left join t o on o.conv_id = t.conv_id - 1), m as (select conv_id, unnest(list_distinct(regexp_extract_all(report, '{_MARKER}'))) as found, regexp_replace(coalesce(history, ''), '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as hi,
 regexp_replace(evidence, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g') as ev from h)
select conv_id, 'fact' as kind, found from m where contains(hi, found) and not contains(ev, found) union all select conv_id, 'heading', w from t, (select unnest(['Licensed', 'password']) as w) where contains(report, w)""")
def history_leakage(spark, d):
    rows = _talks(spark, d)
    before = rows.select((F.col("conv_id") + 1).alias("conv_id"), F.col("evidence").alias("history"))
    return markdown.leaked(rows.join(before, "conv_id", "left"), "conv_id", "report", "history", "evidence", _MARKER, ("Licensed", "password"))


# facts of a domain, and its gate

RULES = facts.Rules(
    topics=(("licence", ("Licensed", "Apache")), ("secret", ("password", "token")), ("period", ("Version", "Copyright"))),
    forbidden=("worthless", "stupid"), scalar=("period",), required=("licence", "secret"),
)
_SQL_RULES = ", ".join(f"{{'fact_type': '{t}', 'label': '{w}'}}" for t, words in RULES.topics for w in words)
_SQL_FACTS = f"""s as (select doc_id, source, unnest(regexp_extract_all(text, '[^.!?;\\n]+')) as raw from documents),
n as (select doc_id, source, trim(trim(regexp_replace(raw, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), '。；; ') as v from s),
c as (select doc_id, source, r.fact_type, r.label, v from n, (select unnest([{_SQL_RULES}], recursive := true)) r where v <> '' and contains(v, r.label) and not contains(v, 'worthless') and not contains(v, 'stupid')),
k as (select *, case when fact_type = 'period' then source || ':' || fact_type else source || ':' || fact_type || ':' || sha256(v) end as fact_key from c),
g as (select fact_key, min(fact_type) as fact_type, min(source) as source, count(*) as candidates, count(distinct v) as distinct_values, min((doc_id, label, v)) as best from k group by 1)"""


@query(f"with {_SQL_FACTS} select fact_key, fact_type, source, candidates, distinct_values, distinct_values > 1 as conflict, case when distinct_values = 1 then best[1] end as doc_id, case when distinct_values = 1 then best[3] end as value from g")
def topic_facts(spark, d):
    return facts.topic_facts(table(spark, d, "documents"), "source", "doc_id", "text", RULES)


@query("""
with r as (select p_brand, p_partkey, p_name || ' | ' || p_type || ' | ' || p_size as t from part), c as (select p_brand, p_partkey, y.fact_type, y.label, t from r, (select unnest([{'fact_type': 'metal', 'label': 'STEEL'}, {'fact_type': 'metal', 'label': 'TIN'}, {'fact_type': 'size', 'label': 'SMALL'}], recursive := true)) y where contains(t, y.label))
select p_brand, fact_type, count(distinct t) as facts, count(*) as candidates from c group by 1, 2""")
def table_facts(spark, d):
    """Facts from rows of tables: the cells of a row as one text."""
    cells = table(spark, d, "part").select("p_brand", "p_partkey", F.posexplode(F.array("p_name", "p_type", F.col("p_size").cast("string"))).alias("c", "v"))
    rules = facts.Rules(topics=(("metal", ("STEEL", "TIN")), ("size", ("SMALL",))))
    found = facts.topic_facts(facts.table_rows(cells, "p_brand", ["p_partkey"], "c", "v"), "p_brand", "item", "text", rules)
    return found.groupBy("p_brand", "fact_type").agg(F.count(F.lit(1)).alias("facts"), F.sum("candidates").alias("candidates"))


@query(f"""
with {_SQL_FACTS}, t as (select source, list_sort(list(distinct fact_type)) as held, bool_or(distinct_values > 1) as conflict from g group by 1),
r as (select source, string_agg(text, chr(10) order by doc_id) as report, count(*) filter (toxic = 1) as unsupported, count(*) filter (quality = 0) as weak from documents join labels using (doc_id) group by 1),
a as (select source, coalesce(held, []) as held, coalesce(conflict, false) as conflict, unsupported, list_filter(['licence', 'secret'], lambda x: list_contains(coalesce(held, []), x) and not (case x when 'licence' then contains(report, 'Licensed') or contains(report, 'Apache') else contains(report, 'password') or contains(report, 'token') end)) as missing from r left join t using (source)),
i as (select *, list_filter([case when conflict then 'rule_conflict' end, case when unsupported > 0 then 'unsupported_claim' end, case when len(missing) > 0 then 'topic_missing' end], lambda x: x is not null) as codes from a)
select source, case when len(codes) > 0 then 'blocked' else 'passed' end as status, coalesce(codes[1], '') as primary_code, array_to_string(codes, ',') as codes, array_to_string(missing, ',') as missing_topics from i""")
def domain_gate(spark, d):
    docs = table(spark, d, "documents")
    both = docs.join(table(spark, d, "labels"), "doc_id")
    told = F.array_distinct(F.flatten(F.collect_set(gates.named_topics(F.col("text"), RULES))))  # sets of topics: few, whatever the texts
    reports = both.groupBy("source").agg(told.alias("named"), F.count_if(F.col("toxic") == 1).alias("unsupported"))
    return gates.domain_gate(reports, "source", "named", "unsupported", facts.topic_facts(docs, "source", "doc_id", "text", RULES), RULES)


# checks of models

_QA_SEVERE = ("major", "blocker", "critical", "high", "fatal", "严重", "重大", "阻断")


@query("""
select event_id, case event_type when 'error' then 'needs_fix' when 'click' then 'pass' else 'ok' end as status, cast(props ->> '$.k' as bigint) % 3 as n_issues, event_type = 'error' or (cast(props ->> '$.k' as bigint) % 3 > 0 and value > 20) as blocks from events""")
def qa_blocks(spark, d):
    """Answers of a checking model: thoughts, a fence, prose around the JSON, braces inside strings."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    issue = F.concat(F.lit('{"severity": "'), F.when(F.col("value") > 20, " Major ").otherwise("minor"), F.lit('", "text": "a } brace \\" {"}'))
    many = F.concat(F.lit("["), F.array_join(F.array_repeat(issue, k), ", "), F.lit("]"))
    status = F.when(F.col("event_type") == "error", "Needs Fix").when(F.col("event_type") == "click", "pass").otherwise("ok")
    raw = F.concat(F.lit("<think>{no}</think> Result:\n```json\n{\"status\": \""), status, F.lit('", "unsupported_claims": '), many, F.lit("}\n``` and {more}"))
    return gates.qa_result(table(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw", _QA_SEVERE)


@query("""
with c as (select item_id, b.text, exists (select 1 from documents d where contains(d.text, b.text)) as whole from benchmark b),
p as (select item_id, whole, list_filter(list_transform(regexp_split_to_array(text, '[,;，；]'), lambda x: trim(x)), lambda x: length(x) >= 6) as parts, text from c),
x as (select item_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from p where not whole), k as (select item_id, part, i from x where exists (select 1 from documents d where contains(d.text, part)))
select p.item_id, case when whole then 'kept' when count(k.part) > 0 then 'narrowed' else 'deleted' end as action, case when whole then p.text else coalesce(string_agg(k.part, ', ' order by k.i), '') end as repaired from p left join k using (item_id) group by p.item_id, whole, p.text""")
def controlled_repair(spark, d):
    return gates.narrowed(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "text")
