"""Queries over packs of several versions, rules as tables, and the parts of packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import packs, rules, versions
from evidra.plans.catalog_packs import _SQL_FIELDS, _fields
from evidra.plans.registry import query
from evidra.sources import table

_SQL_DOCS = """d as (select doc_id, source, lang, text, doc_id % 4 as kind, split_part(text, ' ', 1) as word from documents),
o as (select *, case kind when 0 then 1 when 1 then 2 when 2 then 3 end as version from d),
i as (select doc_id, 1 as version, 'A' as level, 'article_text' as k, text as value, lang <> 'fr' as mandatory from o where kind = 0 union all select doc_id, 1, 'A', 'article_field', source, false from o where kind = 0
 union all select doc_id, 1, case when trim(word) <> '' and contains(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), trim(regexp_replace(word, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) then 'B' else 'C' end, case when trim(word) <> '' and contains(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), trim(regexp_replace(word, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) then 'derived_fact' else 'summary' end, trim(word), false from o where kind = 0
 union all select doc_id, 1, 'C', 'summary', 'no such thing', false from o where kind = 0 union all select doc_id, 1, 'C', 'summary', lang, false from o where kind = 0 union all select doc_id, 1, 'C', 'warning', 'old', false from o where kind = 0
 union all select doc_id, 2, 'A', 'article_text', text, true from o where kind = 1 union all select doc_id, 2, 'C', 'summary', source, false from o where kind = 1),
u as (select doc_id, version, level, k, value, bool_or(mandatory) as mandatory from i where trim(value) <> '' group by 1, 2, 3, 4, 5)"""


@query(f"""
with {_SQL_DOCS}, s as (select doc_id, count(*) filter (level = 'A') as direct, count(*) filter (level = 'B') as derived, count(*) filter (level = 'C') as context, count(*) filter (mandatory) as mandatory,
 sha256(string_agg(level || k || sha256(value), ',' order by level, k, sha256(value))) as digest from u group by 1)
select o.doc_id, o.version, case kind when 2 then 'unknown_version' when 3 then 'not_an_object' else '' end as problem, case when kind = 0 then 'extra,legacy' else '' end as lost, coalesce(direct, 0) as direct, coalesce(derived, 0) as derived, coalesce(context, 0) as context, coalesce(mandatory, 0) as mandatory, coalesce(digest, '') as digest from o left join s using (doc_id)""")
def pack_versions(spark, d):
    """Packs of version 1, version 2, an unknown version, and damaged ones, in one column: their items, and what was lost."""
    word = F.split("text", " ")[0]
    fact = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    material = F.struct(F.col("source").alias("title"), F.col("text").alias("content_text"), F.col("lang").alias("summary"), F.array(fact("first", word), fact("none", F.lit("no such thing"))).alias("key_facts"))
    none = F.expr("cast(array() as array<struct<title:string,content_text:string,summary:string,key_facts:array<struct<name:string,value:string>>>>)")
    first = F.to_json(F.struct(F.when(F.col("lang") != "fr", F.array(material)).otherwise(none).alias("primary_materials"), F.when(F.col("lang") == "fr", F.array(material)).otherwise(none).alias("auxiliary_materials"), F.array(F.lit("old")).alias("warnings"), F.lit(1).alias("legacy"), F.lit("x").alias("extra")))
    item = lambda level, kind, value, must: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(must).alias("mandatory"))
    second = F.to_json(F.struct(F.lit(2).alias("evidence_schema_version"), F.array(item("A", "article_text", F.col("text"), True), item("C", "summary", F.col("source"), False)).alias("evidence_items")))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, first).when(kind == 1, second).when(kind == 2, '{"evidence_schema_version": 3}').otherwise(F.concat(F.lit('{"cut": "'), "source"))
    told = versions.parsed(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw")
    of = lambda level: F.count_if(F.col("level") == level)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "kind", F.sha2("value", 256).alias("v")))), lambda x: F.concat(x["level"], x["kind"], x["v"])), ",")
    found = versions.items(told).groupBy("pack").agg(of("A").alias("direct"), of("B").alias("derived"), of("C").alias("context"), F.count_if("mandatory").alias("mandatory"), F.sha2(said, 256).alias("digest"))
    out = told.join(found, "pack", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "derived", "context", "mandatory")]
    return out.select(F.col("pack").alias("doc_id"), "version", F.coalesce("problem", F.lit("")).alias("problem"), F.array_join("lost", ",").alias("lost"), *counts, F.coalesce("digest", F.lit("")).alias("digest"))


@query("""
with t as (select p_partkey as entry, p_brand as id, ['table', 'section', 'chart', ' '][p_size % 4 + 1] as shown, case when p_size % 7 = 0 then '' else p_type end as code, p_size % 5 > 0 as coded from part),
m as (select entry, 'failure_code' as field, 'missing' as problem from t where not coded or code = '' union all select entry, 'presentation', 'missing' from t where shown = ' '),
b as (select entry, 'presentation' as field, 'blank' as problem from t where shown = ' ' union all select entry, 'failure_code', 'blank' from t where coded and code = ''),
p as (select entry, 'presentation' as field, 'unknown_presentation' as problem from t where shown = 'chart'),
r as (select entry, 'topic_id' as field, 'repeated' as problem from t qualify entry > min(entry) over (partition by id))
select 'topics' as section, cast(entry as int) as entry, field, problem from (from m union all from b union all from p union all from r) union all select 'sections', null, '', 'missing_section' union all select 'trigger', 0, 'menu_names', 'missing'""")
def rule_violations(spark, d):
    """Rules made of parts, with all kinds of faults."""
    shown = F.element_at(F.array(*map(F.lit, ("table", "section", "chart", " "))), F.col("p_size") % 4 + 1)
    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    code = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type"))
    each = F.array_compact(F.array(field("topic_id", F.col("p_brand")), field("presentation", shown), F.when(F.col("p_size") % 5 > 0, field("failure_code", code))))
    topics = table(spark, d, "part").select(F.lit("topics").alias("section"), F.col("p_partkey").cast("int").alias("entry"), F.inline(each))
    rest = spark.createDataFrame([("version", 0, "version", "1"), ("trigger", 0, "title_keywords", "x")], rules.SCHEMA)
    return rules.violations(topics.unionByName(rest))


@query(f"""
with {_SQL_FIELDS}, v as (select * from (values ('primary_evidence', 'attachment_summaries', 'primary', 'summary', true), ('primary_evidence', 'policy', 'primary', 'policy_rules', false), ('auxiliary_evidence', 'policy', 'auxiliary', 'policy_rules', false),
 ('attachment_evidence', 'parsed_summaries', '*', 'summary', true), ('attachment_evidence', 'table_summaries', '*', 'sections', true), ('attachment_evidence', 'warnings', '*', 'warnings', false)) v(stage, name, of_role, field, files)),
x as (select f.*, stage, name from f join v on f.field = v.field and (of_role = '*' or of_role = role) and files = (attachment >= 0) where trim(text) <> '')
select pack, stage, name, count(*) as texts, count(distinct (role, material)) as from_materials, sha256(string_agg(text, chr(30) order by role desc, material, attachment, i)) as digest from x group by 1, 2, 3""")
def pack_stages(spark, d):
    """The parts of packs that a model is shown: lists over all their materials, in order."""
    stages = (
        ("primary_evidence", "attachment_summaries", "primary", "summary"), ("primary_evidence", "policy", "primary", "policy_rules"), ("auxiliary_evidence", "policy", "auxiliary", "policy_rules"),
        ("attachment_evidence", "parsed_summaries", "*", "summary"), ("attachment_evidence", "table_summaries", "*", "sections"), ("attachment_evidence", "warnings", "*", "warnings"),
    )
    out = packs.stage_lists(_fields(spark, d).drop("lang"), stages)
    return out.select("pack", "stage", "name", F.size("texts").cast("long").alias("texts"), "from_materials", F.sha2(F.array_join("texts", "\x1e"), 256).alias("digest"))
