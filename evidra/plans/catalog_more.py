"""Queries over documents in JSON, packs, runs as they are shown, and files and logs written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import sinks, sources
from evidra.functions import scalars, text
from evidra.operators import budgets, documents, evaluate, evidence, gates, grids, predicates, records
from evidra.plans.registry import query, quoted
from evidra.sinks import docx
from evidra.sources import files, table
from evidra.sources.staging import shared_dir

# records


@query("""
with k as (select o_custkey % 10 as p, o_orderkey from orders where o_totalprice > 400000) select o.o_orderkey, o_orderstatus, p from k join orders o on o.o_orderkey = k.o_orderkey where o_orderstatus <> 'P'""")
def keyed_lookup(spark, d):
    """Records by a list of keys, active ones only: the list is joined, whatever its size."""
    orders = table(spark, d, "orders")
    keys = orders.where("o_totalprice > 400000").select("o_orderkey", (F.col("o_custkey") % 10).alias("p"))
    return keys.join(orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "o_orderstatus", "p")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders")
def api_rows(spark, d):
    return sources.normalised_rows(table(spark, d, "orders"))


@query("""
with c as (select o_orderkey, max(l_quantity) > 45 as led from orders left join lineitem on l_orderkey = o_orderkey group by 1) select o.o_orderkey, o_totalprice < 150000 and coalesce(led, false) as attachment_led from orders o join c using (o_orderkey)""")
def led_records(spark, d):
    child = F.struct(F.lit(True).alias("core"), (F.col("l_quantity") > 45).alias("usable"), F.lit(900).alias("chars"))
    children = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(child).alias("children"))  # at most two different ones
    rows = table(spark, d, "orders").join(children, "o_orderkey", "left")
    led = predicates.attachment_led(F.col("o_totalprice"), F.coalesce("children", F.array().cast("array<struct<core:boolean,usable:boolean,chars:int>>")), 150_000, 800)
    return rows.select("o_orderkey", led.alias("attachment_led"))


@query("""
select p_partkey, (p_brand in ('Brand#11', 'Brand#12') or p_size = 1) and (contains(p_name, 'a') or contains(p_type, 'STEEL')) as applies from part""")
def applicable_records(spark, d):
    yes = predicates.applicable(F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"), ["Brand#11", "Brand#12"], ["1"], ["a"], ["STEEL"])
    return table(spark, d, "part").select("p_partkey", yes.alias("applies"))


@query("""
select p_partkey, replace(trim(p_name || ' : ' || p_brand || '. ', '。！？!?；;，,：:|*-_`> '), ' ', '') as claim, length(replace(p_name || p_brand, ' ', '')) >= 9 as states_something from part""")
def claim_texts(spark, d):
    said = F.concat("p_name", F.lit("　： "), "p_brand", F.lit(". "))
    plain = F.regexp_replace(F.concat("p_name", "p_brand"), " ", "")
    return table(spark, d, "part").select("p_partkey", text.claim_text(said).alias("claim"), (F.length(text.claim_text(plain)) >= 9).alias("states_something"))


@query("""
with w as (select unnest([1, 2, 3, 999999999]) as o_orderkey) select w.o_orderkey, o_orderstatus, case when o.o_orderkey is null then 404 else 200 end as status from w left join orders o using (o_orderkey)""")
def record_lookup(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,), (999_999_999,)], "o_orderkey long")
    return records.lookups(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), wanted, "o_orderkey")


@query("""
with n as (select p_partkey, p_brand || '.docx' as name, row_number() over (partition by p_brand order by p_partkey) as k from part) select p_partkey, case when k = 1 then name else replace(name, '.docx', '_' || k || '.docx') end as unique_name from n""")
def unique_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(".docx")).alias("name"))
    return records.unique_names(rows, "name", [F.col("p_partkey")]).select("p_partkey", "unique_name")


@query("""
with f as (select l_orderkey, list((40 + case when l_returnflag = 'R' then 35 else 0 end + case when l_linestatus = 'O' then 20 else 0 end + least(25, 2 * l_linenumber) + case when l_quantity > 25 then 15 else -8 end + least(40, cast(floor(l_tax * 500) as int))) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as files from lineitem group by 1)
select o_orderkey, coalesce(len(files), 0) as n_files, cast(greatest(0, 60 + least(30, 2 * (o_orderkey % 20)) + case when len(files) > 0 then least(70, list_max(files) + floor(list_sum(files[1:3]) / 5)) else 0 end) as bigint) as score from orders left join f on l_orderkey = o_orderkey""")
def record_scores(spark, d):
    of = scalars.file_score(F.lit(True), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_linenumber"), F.when(F.col("l_quantity") > 25, "parsed_text").otherwise("metadata_only"), F.floor(F.col("l_tax") * 500).cast("int"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", of.alias("s")))), lambda x: x.s).alias("files"))
    rows = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("files", F.coalesce("files", F.array().cast("array<bigint>")))
    return rows.select("o_orderkey", F.size("files").cast("long").alias("n_files"), scalars.record_score(F.lit(True), F.col("o_orderkey") % 20, F.lit(0.0), F.col("files")).alias("score"))


# corpora and packs


@query("""
with tok as (select lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as w from documents where lang in ('en', 'fr')), n as (select w, count(*) filter (lang = 'en') as a, count(*) filter (lang = 'fr') as b from tok group by 1)
select 'left' as side, w, a as n from (select * from n where b = 0 order by a desc, w limit 80) union all select 'right', w, b from (select * from n where a = 0 order by b desc, w limit 80)""")
def missing_terms(spark, d):
    """The 80 most frequent terms of each side that the other one lacks."""
    words = table(spark, d, "documents").where("lang in ('en', 'fr')").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("w"))
    n = words.groupBy("w").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "fr").alias("b"))
    side = lambda name, own, other: n.where(f"{other} = 0").orderBy(F.desc(own), "w").limit(80).select(F.lit(name).alias("side"), "w", F.col(own).alias("n"))
    return side("left", "a", "b").unionByName(side("right", "b", "a"))


@query("""
with r as (select o_orderpriority as role, o_custkey % 50 as article, l_suppkey % 5 as attachment, l_returnflag as h, l_linestatus || l_returnflag as summary, l_quantity from orders join lineitem on l_orderkey = o_orderkey)
select role, article, attachment, count(*) as n, array_to_string(list_sort(list(distinct h)), ',') as headers, arg_max(summary, (l_quantity, summary)) as longest from r group by 1, 2, 3""")
def fidelity_catalog(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    summary = F.concat("l_linestatus", "l_returnflag")
    return rows.groupBy(F.col("o_orderpriority").alias("role"), (F.col("o_custkey") % 50).alias("article"), (F.col("l_suppkey") % 5).alias("attachment")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("headers"), F.max_by(summary, F.struct("l_quantity", summary)).alias("longest")
    )


@query("select event_type as code, count(*) as n, count(distinct user_id) as runs from events where value > 60 group by 1")
def failure_histogram(spark, d):
    return table(spark, d, "events").where("value > 60").groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("runs"))


@query("""
with t as (select l_orderkey, count(distinct l_returnflag || l_linestatus) as flags, count(distinct l_linenumber) as fields, count(*) as n from lineitem group by 1), s as (select l_orderkey, least(35, 8 * flags) + least(35, 6 * fields) + case when n > 4 then 20 else 0 end as score from t)
select o_orderpriority, count(*) as packs, cast(sum(score) as bigint) as table_total, max(score) as best from orders join s on l_orderkey = o_orderkey group by 1""")
def score_totals(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("flags"), F.countDistinct("l_linenumber").alias("fields"), F.count(F.lit(1)).alias("n"))
    scored = lines.withColumn("score", scalars.table_score(F.col("flags"), F.col("fields"), F.col("n"), F.col("n") > 4))
    return table(spark, d, "orders").join(scored, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("packs"), F.sum("score").alias("table_total"), F.max("score").alias("best"))


@query("select event_type as category, left(props, 7) as said, min(event_id) as first_id, count(*) as n from events group by 1, 2")
def issue_dedup(spark, d):
    """Issues that say the same in a category are one, by their canonical hash."""
    rows = table(spark, d, "events").withColumn("h", text.canonical_hash({"category": F.col("event_type"), "said": F.substring("props", 1, 7)}))
    return rows.groupBy("h").agg(F.first("event_type").alias("category"), F.first(F.substring("props", 1, 7)).alias("said"), F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("h")


#: Shares of a pack for each strategy, in percent.
SHARES = (
    ("attachment_led", "primary_body", 18), ("attachment_led", "primary_attachment", 57), ("attachment_led", "auxiliary", 10), ("attachment_led", "guidance", 15), ("table_heavy", "primary_body", 18),
    ("table_heavy", "table_summary", 52), ("table_heavy", "attachment_sections", 20), ("table_heavy", "auxiliary", 10), ("safe_compact", "primary_body", 30), ("safe_compact", "primary_attachment", 45),
    ("safe_compact", "auxiliary", 10), ("safe_compact", "omitted", 15), ("light_compact", "primary_body", 35), ("light_compact", "primary_attachment", 35), ("light_compact", "auxiliary", 15), ("light_compact", "guidance", 15),
)
_SQL_SHARES = ", ".join(f"('{s}', '{p}', {n})" for s, p, n in SHARES)


@query(f"""
with s as (select source, cast(sum(length(text)) as bigint) as total, min(length(text)) < 60 as led from documents group by 1), t as (select source, total, case when led then 'attachment_led' when total <= 65000 then 'full_input' when total <= 75000 then 'light_compact' when total <= 80000 then 'safe_compact' else 'staged_generation' end as strategy from s)
select source, t.strategy, part, cast(least(total, 80000) * pct // 100 as bigint) as chars from t join (values {_SQL_SHARES}) v(strategy, part, pct) on v.strategy = t.strategy""")
def strategy_budgets(spark, d):
    n = F.length("text")
    s = table(spark, d, "documents").groupBy("source").agg(F.sum(n).cast("long").alias("total"), (F.min(n) < 60).alias("led"))
    t = s.withColumn("strategy", scalars.input_strategy(F.lit(1), F.col("led"), F.lit(False), F.col("total")))
    shares = spark.createDataFrame(list(SHARES), "strategy string, part string, pct long")
    return t.join(F.broadcast(shares), "strategy").select("source", "strategy", "part", F.expr("least(total, 80000) * pct div 100").alias("chars"))  # 16 rows


@query("""
with s as (select source, doc_id, length(text) as n from documents), t as (select source, cast(sum(n) as bigint) as total from s group by 1),
p as (select *, case when total <= 80000 then total when total <= 90000 then 79500 else 79000 end as ceiling from t), x as (select source, doc_id, n, total, ceiling, greatest(n - 400, 0) as room, sum(greatest(n - 400, 0)) over (partition by source order by n desc, doc_id rows unbounded preceding) as running from s join p using (source))
select source, total, cast(sum(n - least(room, greatest(total - ceiling - (running - room), 0))) as bigint) as left_chars, sum(n - least(room, greatest(total - ceiling - (running - room), 0))) <= ceiling as fits, count(*) as items from x group by 1, 2, ceiling""")
def compaction(spark, d):
    """A pack above its limit is brought below the ceiling of its tier: the longest texts are cut first, none below 400 characters."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    totals = rows.groupBy("source").agg(F.sum("n").alias("total")).withColumn("ceiling", scalars.tier_window(F.col("total")).ceiling)
    out = budgets.trimmed_to(rows.join(totals, "source"), "source", "doc_id", "n", F.col("total") - F.col("ceiling"), 400)
    return out.groupBy("source", "total", "ceiling").agg(F.sum("left").alias("left_chars"), F.count(F.lit(1)).alias("items")).select("source", "total", "left_chars", (F.col("left_chars") <= F.col("ceiling")).alias("fits"), "items")


# documents in JSON


@query("""select event_id, 'a' || event_id || ' ' || event_type || ' ' || cast(value > 50 as varchar) || ' x y' as flat, 5 as n from events""")
def flattened_strings(spark, d):
    raw = F.concat(F.lit('{"z": ["x", {"k": " y "}], "b": "'), "event_type", F.lit('", "a": "a'), F.col("event_id"), F.lit('", "c": "'), (F.col("value") > 50).cast("string"), F.lit('", "d": null, "e": ""}'))
    return documents.flattened(table(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw")


@query("""
select event_id, case event_type when 'error' then '' when 'signup' then '' else 'w' || event_id end as run_id, case event_type when 'error' then '' when 'signup' then '' when 'view' then '' else '# R' || event_id end as text,
 case event_type when 'error' then 'workflow_failed' when 'signup' then 'workflow_id_missing' when 'view' then 'output_empty' when 'click' then case when value > 50 then 'output_truncated' else '' end else '' end as failure from events""")
def unwrapped_outputs(spark, d):
    kind, report = F.col("event_type"), F.concat(F.lit("# R"), F.col("event_id"))
    run = F.when(kind == "signup", "").otherwise(F.concat(F.lit("w"), F.col("event_id")))
    inner = F.when(kind == "view", "{}").when(kind == "purchase", F.concat(F.lit('{"text": "<think>{0}</think> ```json\\n{\\"report_markdown\\": \\"'), report, F.lit('\\"}\\n```"}'))).otherwise(F.concat(F.lit('{"report_markdown": "'), report, F.lit('"}')))
    reason = F.when((kind == "click") & (F.col("value") > 50), "length").otherwise("stop")
    raw = F.concat(F.lit('{"workflow_run_id": "'), run, F.lit('", "data": {"status": "'), F.when(kind == "error", "Failed").otherwise("succeeded"), F.lit('", "finish_reason": "'), reason, F.lit('", "outputs": '), inner, F.lit("}}"))
    return documents.unwrapped(table(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw")


@query("""
select p_partkey, 'title' as location, p_name as text from part union all select p_partkey, 'sections[0].heading', p_brand from part union all select p_partkey, 'sections[0].paragraphs[0]', 'a "quoted" word of ' || p_size from part""")
def report_json(spark, d):
    """Reports as JSON in prose, with quotes that nobody escaped, hidden keys and a wrapper."""
    raw = F.concat(
        F.lit('Here it is: {"report_ir": {"title": "'), "p_name", F.lit('", "thinking": "no", "sections": [{"heading": "'), "p_brand", F.lit('", "paragraphs": ["a "quoted" word of '), F.col("p_size"), F.lit('", ""]}]}} done')
    )
    return documents.report_texts(table(spark, d, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw")


# gates and runs


@query("""
with b as (select doc_id, not (contains(text, 'password') or contains(text, 'worthless')) and trim(text) <> '' as body, coalesce(toxic = 0, false) as clean, coalesce(quality = 1, false) as good from documents left join labels using (doc_id))
select doc_id, body and clean and good as passed, array_to_string(list_filter([case when not body then 'body' end, case when not clean then 'clean' end, case when not good then 'good' end], lambda x: x is not null), ',') as failed_gates from b""")
def gate_chain(spark, d):
    labels = table(spark, d, "labels")
    body = lambda r: r.select("doc_id", ((F.size(text.hits(F.col("text"), ("password", "worthless"))) == 0) & (F.trim("text") != "")).alias("passed"))
    of = lambda c: lambda r: labels.select("doc_id", c.alias("passed"))
    return gates.chain(table(spark, d, "documents"), [("body", body), ("clean", of(F.col("toxic") == 0)), ("good", of(F.col("quality") == 1))], "doc_id")


_RICH = ("the", "and", "que", "der", "les", "with")


@query(f"""
with b as (select doc_id, length(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g')) as n, len(regexp_split_to_array(trim(text, ' ' || chr(10)), '\\n+')) as sections, len(list_filter([{quoted(_RICH)}], lambda k: contains(text, k))) >= 2 and length(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g')) >= 300 as rich, regexp_extract(text, 'Version ([0-9.]+)', 1) as crawl from documents),
i as (select doc_id, list_filter([case when rich and n < 1800 then 'report_depth' end, case when rich and sections < 4 then 'few_sections' end, case when crawl <> '' then 'crawl_insufficient' end], lambda x: x is not null) as issues, crawl from b)
select doc_id, array_to_string(issues, ',') as issues, case when len(issues) = 0 then 'pass' when crawl <> '' then 'block' else 'needs_fix' end as status from i""")
def report_against_evidence(spark, d):
    t = F.col("text")
    n, sections = F.length(F.regexp_replace(t, "\\s+", "")), F.size(F.split(F.trim(t, F.lit(" \n")), "\n+"))
    rich, crawl = predicates.rich(t, _RICH, 2, 300), F.regexp_extract(t, "Version ([0-9.]+)", 1)
    rows = table(spark, d, "documents").withColumn("i", gates.ordered_codes({"report_depth": rich & (n < 1800), "few_sections": rich & (sections < 4), "crawl_insufficient": crawl != ""}, ["report_depth", "few_sections", "crawl_insufficient"]))
    return rows.select("doc_id", F.array_join("i", ",").alias("issues"), F.when(F.size("i") == 0, "pass").when(crawl != "", "block").otherwise("needs_fix").alias("status"))


_CODES = ("core_unparsed", "auxiliary_dominant", "near_limit", "compacted", "warnings")


@query("""
with p as (select source, sum(length(text)) as total, sum(case when lang = 'en' then length(text) else 0 end) as primary_chars, sum(case when lang <> 'en' then length(text) else 0 end) as other, sum(least(length(text), 3000)) as compact, bool_or(length(text) < 60) as core, bool_or(contains(text, 'password')) as warned from documents group by 1),
c as (select *, list_filter([case when core then 'core_unparsed' end, case when other > greatest(primary_chars * 2, 2000) then 'auxiliary_dominant' end, case when compact > 75000 then 'near_limit' end, case when compact > 0 and total > compact * 1.2 then 'compacted' end, case when warned then 'warnings' end], lambda x: x is not null) as codes from p)
select source, case when len(codes) = 0 then 'ok' else array_to_string(codes, ',') end as diagnosis, list_contains(codes, 'core_unparsed') or list_contains(codes, 'compacted') as needs_review from c""")
def pack_diagnostics(spark, d):
    n = F.length("text")
    p = table(spark, d, "documents").groupBy("source").agg(
        F.sum(n).alias("total"), F.sum(F.when(F.col("lang") == "en", n).otherwise(0)).alias("primary_chars"), F.sum(F.when(F.col("lang") != "en", n).otherwise(0)).alias("other"),
        F.sum(F.least(n, F.lit(3000))).alias("compact"), F.bool_or(n < 60).alias("core"), F.bool_or(F.contains("text", F.lit("password"))).alias("warned"),
    )
    c = F.col
    found = {"core_unparsed": c("core"), "auxiliary_dominant": c("other") > F.greatest(c("primary_chars") * 2, F.lit(2000)), "near_limit": c("compact") > 75_000, "compacted": (c("compact") > 0) & (c("total") > c("compact") * 1.2), "warnings": c("warned")}
    codes = gates.ordered_codes(found, _CODES)
    return p.select("source", F.when(F.size(codes) == 0, "ok").otherwise(F.array_join(codes, ",")).alias("diagnosis"), (F.array_contains(codes, "core_unparsed") | F.array_contains(codes, "compacted")).alias("needs_review"))


@query("""
with r as (select user_id, case arg_max(event_type, (ts, event_id)) when 'purchase' then 'finished' when 'signup' then 'needs_manual_review' when 'error' then 'failed' else 'running' end as status, count(*) filter (event_type = 'view') > 0 as body, count(*) filter (event_type = 'error' and value > 90) > 0 as repair_failed,
 max(value) > 80 as flagged, case when max(value) > 95 then 'deliverable' when max(value) > 85 then 'needs_manual_review' else '' end as gate, min(value) > 1 as passed from events group by 1),
x as (select *, status = 'finished' and body and case when gate <> '' then gate = 'deliverable' else passed end as explicitly from r)
select user_id, status, body and not repair_failed and explicitly as deliverable, body and not repair_failed and status in ('finished', 'needs_manual_review') and flagged as exportable, body and not repair_failed and status in ('finished', 'needs_manual_review') and flagged and explicitly as final_export from x""")
def run_normalization(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    r = table(spark, d, "events").groupBy("user_id").agg(
        last.alias("last"), (F.count_if(kind == "view") > 0).alias("body"), (F.count_if((kind == "error") & (value > 90)) > 0).alias("repair_failed"), (F.max("value") > 80).alias("flagged"),
        F.when(F.max("value") > 95, "deliverable").when(F.max("value") > 85, "needs_manual_review").otherwise("").alias("gate"), (F.min("value") > 1).alias("passed"),
    )
    r = r.withColumn("status", F.when(F.col("last") == "purchase", "finished").when(F.col("last") == "signup", "needs_manual_review").when(F.col("last") == "error", "failed").otherwise("running"))
    state = gates.delivery(F.col("status"), F.col("body"), F.col("repair_failed"), F.col("flagged"), F.col("gate"), F.col("passed"))
    return r.select("user_id", "status", state.deliverable.alias("deliverable"), state.exportable.alias("exportable"), state.final_export.alias("final_export"))


@query("""
with u as (select conv_id, string_agg(text, chr(10) order by turn) filter (role = 'assistant') as a, string_agg(text, chr(10) order by turn) filter (role = 'user') as q from conversations group by 1)
select conv_id, coalesce(length(a), 0) < 400 as fallback, case when coalesce(length(a), 0) < 400 then '# Report' || chr(10) || chr(10) || left(coalesce(q, ''), 200) else a end as report, case when coalesce(length(a), 0) < 400 then 'needs_manual_review' else 'finished' end as status from u""")
def fallback_reports(spark, d):
    """A report that can't be used is replaced by one from its evidence, and never counts as finished."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("t"))
    of = lambda role, name: F.max(F.when(F.col("role") == role, F.col("t"))).alias(name)
    u = turns.groupBy("conv_id").agg(of("assistant", "a"), of("user", "q"))
    return gates.with_fallback(u, "conv_id", F.col("a"), F.length(F.coalesce("a", F.lit(""))) < 400, F.concat(F.lit("# Report\n\n"), F.substring(F.coalesce("q", F.lit("")), 1, 200)))


@query("""
with l as (select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as seen, list(distinct event_type) as names from events group by 1)
select user_id, status, seen from l where list_contains(names, 'purchase') and status in ('view', 'click') and contains(lower('U' || user_id || ' ' || status), '1')""")
def history_filter(spark, d):
    """Runs by an identity anywhere in them, by their state, and by a text in any case over several fields."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("seen"), F.collect_set("event_type").alias("names"))
    return last.where(F.array_contains("names", "purchase") & F.col("status").isin("view", "click") & F.contains(F.lower(F.concat_ws(" ", F.concat(F.lit("U"), "user_id"), "status")), F.lit("1"))).select("user_id", "status", "seen")


@query("""
with r as (select user_id, event_id, ts, value from events), g as (select user_id, max((ts, event_id, value)) as x, count(*) as n from r where event_id % 10 <> 3 group by 1), b as (select user_id, count(*) as skipped from r where event_id % 10 = 3 group by 1)
select coalesce(g.user_id, b.user_id) as user_id, coalesce(n, 0) as revisions, coalesce(skipped, 0) as skipped, x[2] as event_id, x[3] as value from g full join b on g.user_id = b.user_id""")
def rebuilt_history(spark, d):
    """The history from raw lines, some of which are damaged (here those with an id ending in 3): the last good one of each run, and how many
    were skipped."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    raw = rows.select("user_id", F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 12, "ts')).otherwise(F.to_json(F.struct("event_id", "ts", "value"))).alias("line"))
    parsed = raw.withColumn("x", F.from_json("line", "event_id long, ts timestamp_ntz, value double, _corrupt_record string", {"mode": "PERMISSIVE"}))
    good = F.col("x._corrupt_record").isNull()
    last = F.max_by("x", F.when(good, F.struct("x.ts", "x.event_id")))
    return parsed.groupBy("user_id").agg(F.count_if(good).alias("revisions"), F.count_if(~good).alias("skipped"), last.alias("l")).select("user_id", "revisions", "skipped", "l.event_id", "l.value")


@query("""
select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, count(*) filter (role = 'assistant') as answers, max(length(text)) as longest, count(*) filter (contains(text, '?')) > 0 as asks, case when sum(length(text)) < 800 then 'short' when count(*) filter (role = 'assistant') = 0 then 'unanswered' else 'complete' end as verdict from conversations group by 1""")
def quality_eval(spark, d):
    n, answers = F.length("text"), F.count_if(F.col("role") == "assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(n).cast("long").alias("chars"), answers.alias("answers"), F.max(n).cast("long").alias("longest"), (F.count_if(F.contains("text", F.lit("?"))) > 0).alias("asks"),
        F.when(F.sum(n) < 800, "short").when(answers == 0, "unanswered").otherwise("complete").alias("verdict"),
    )


@query("""
select event_id, case when event_type = 'error' then 1 else 2 end as from_version, 3 as schema_version, event_type as kind, case when event_type = 'error' then null else cast(props ->> '$.k' as bigint) end as k, event_type = 'error' as adapted from events""")
def converted_schema(spark, d):
    """Rows of older versions brought to the newest one: what a version lacks is null, and rows that had to be adapted are marked."""
    old = F.col("event_type") == "error"
    version = F.when(old, 1).otherwise(2)
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", version.alias("from_version"), F.lit(3).alias("schema_version"), F.col("event_type").alias("kind"), F.when(~old, k).alias("k"), old.alias("adapted"))


@query("""
with p as (select doc_id, unnest(regexp_split_to_array(text, '\\n')) as page from documents), c as (select doc_id, count(*) as pages, count(*) filter (length(page) >= 40) as good from p group by 1)
select doc_id, pages, good, case when good = pages then 'parsed' when good > 0 then 'partial' else 'failed' end as status from c""")
def page_status(spark, d):
    """Lines as pages: a document is parsed if all of its pages are, partial if some are."""
    pages = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("page"))
    good, n = F.count_if(F.length("page") >= 40), F.count(F.lit(1))
    return pages.groupBy("doc_id").agg(n.alias("pages"), good.alias("good"), F.when(good == n, "parsed").when(good > 0, "partial").otherwise("failed").alias("status"))


@query("""
with t as (select 'part' as tbl, 6 as n_columns, ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'] as h, (select count(*) from part) as n union all select 'supplier', 4, ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'], (select count(*) from supplier)
 union all select 'customer', 5, ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], (select count(*) from customer)),
k as (select *, list_filter(['key', 'name', 'price', 'status'], lambda x: len(list_filter(h, lambda c: case x when 'key' then contains(c, 'key') when 'name' then contains(c, 'name') or contains(c, 'brand') when 'price' then contains(c, 'acctbal') else contains(c, 'type') or contains(c, 'segment') end)) > 0) as kinds from t)
select tbl, n as n_rows, n_columns, array_to_string(kinds, ',') as kinds, n >= 1000 as heavy, cast(least(35, 8 * len(kinds)) + least(35, 6 * len(kinds)) + case when n >= 1000 then 20 else 0 end + case when n >= 5000 then 10 else 0 end as bigint) as score from k""")
def table_summaries(spark, d):
    """What a table is, told by its headers and its size: kinds of columns, whether it is heavy, how much evidence it holds."""
    kinds = {"key": ("key",), "name": ("name", "brand"), "price": ("acctbal",), "status": ("type", "segment")}
    rows = None
    for name in ("part", "supplier", "customer"):
        t = table(spark, d, name)
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("tbl"), "n_rows", F.lit(len(t.columns)).alias("n_columns"), F.array(*map(F.lit, t.columns)).alias("h"))
        rows = one if rows is None else rows.unionByName(one)
    found = F.array_intersect(F.array(*map(F.lit, kinds)), F.array_distinct(F.flatten(F.transform("h", lambda c: grids.kinds_of(c, kinds)))))
    rows = rows.withColumn("kinds", found).withColumn("heavy", F.col("n_rows") >= 1000)
    return rows.select("tbl", "n_rows", "n_columns", F.array_join("kinds", ",").alias("kinds"), "heavy", scalars.table_score(F.size("kinds"), F.size("kinds"), F.col("n_rows"), F.col("heavy")).alias("score"))


@query("""
with i as (select 'o' || o_orderkey as item, case when o_orderstatus = 'P' then 'F' else o_orderstatus end as hash from orders), l as (select 'o' || l_orderkey as item, l_linestatus as hash from lineitem)
select i.item, count(l.item) as n_sources, i.hash from i join l using (item) group by i.item, i.hash having not bool_or(l.hash = i.hash)""")
def hash_violations(spark, d):
    """Derived items whose source hash none of their sources has."""
    items = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("hash"))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("item"), F.col("l_linestatus").alias("hash"))
    return evidence.unmatched_hashes(items, links, "item", "hash")


@query("""
with a as (select source, count(*) filter (quality = 1) as ab, count(*) filter (quality = 1 and toxic = 0) as supported, count(*) filter (toxic = 1) as c_used, sum(n_chars) as chars, count(*) filter (quality = 1) as mandatory, count(*) filter (quality = 1 and n_chars > 100) as retained from documents join labels using (doc_id) group by 1),
e as (select *, list_filter([case when ab = 0 then 'evidence_missing' when supported <> ab then 'support_below_100' end, case when c_used > 0 then 'c_level_used' end, case when chars > 80000 then 'limit_exceeded' end, case when mandatory > 0 and retained / mandatory < 0.9 then 'retention_below_90' end], lambda x: x is not null) as codes from a)
select source, coalesce(round(supported / nullif(ab, 0), 6), 0.0) as rate, array_to_string(codes, ',') as errors, len(codes) = 0 as passed from e""")
def artifact_verdict(spark, d):
    c = F.col
    a = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        F.count_if(c("quality") == 1).alias("ab"), F.count_if((c("quality") == 1) & (c("toxic") == 0)).alias("supported"), F.count_if(c("toxic") == 1).alias("c_used"), F.sum("n_chars").alias("chars"), F.count_if((c("quality") == 1) & (c("n_chars") > 100)).alias("retained")
    )
    found = {
        "evidence_missing": c("ab") == 0, "support_below_100": (c("ab") > 0) & (c("supported") != c("ab")), "c_level_used": c("c_used") > 0, "limit_exceeded": c("chars") > 80_000,
        "retention_below_90": F.when(c("ab") > 0, c("retained") / c("ab") < 0.9).otherwise(False),
    }
    codes = gates.ordered_codes(found, list(found))
    return a.select("source", F.coalesce(F.round(c("supported") / F.when(c("ab") > 0, c("ab")), 6), F.lit(0.0)).alias("rate"), F.array_join(codes, ",").alias("errors"), (F.size(codes) == 0).alias("passed"))


@query("""
with b as (select c_custkey, length(to_json({'chars': 0, 'name': c_name})) + 3 - 1 as b from customer), n as (select c_custkey, b, list_filter(range(1, 12), lambda k: length(cast(b + k as varchar)) = k)[1] as k from b) select c_custkey, cast(b + k as bigint) as chars from n""")
def self_sizes(spark, d):
    """The size of a JSON record that tells its own size."""
    base = text.json_chars({"chars": F.lit(0), "name": F.col("c_name")}) - 1
    return table(spark, d, "customer").select("c_custkey", text.with_own_size(base).alias("chars"))


# written and read again


@query("""
select p_partkey, 'Report on ' || p_name || chr(10) || 'made by ' || p_brand || ' & <sons>' || chr(10) || 'Name | Size' || chr(10) || p_name || ' | ' || p_size as text from part where p_size <= 40""")
def docx_roundtrip(spark, d):
    """Reports as text documents, rendered only where they may be published, and read again."""
    rows = table(spark, d, "part")
    parts = rows.select("p_partkey", "p_size", F.posexplode(F.array(
        F.struct(F.lit("title").alias("part"), F.concat(F.lit("Report on "), "p_name").alias("text")), F.struct(F.lit("lead").alias("part"), F.concat(F.lit("made by "), "p_brand", F.lit(" & <sons>")).alias("text")),
        F.struct(F.lit("table").alias("part"), F.lit("Name | Size").alias("text")), F.struct(F.lit("row").alias("part"), F.concat_ws(" | ", "p_name", F.col("p_size").cast("string")).alias("text")),
    )).alias("place", "x")).select("p_partkey", "p_size", "place", "x.*")
    return files.docx_texts(docx.rendered(parts, "p_partkey", F.col("p_size") <= 40), "p_partkey", "content")




@query("select event_id, user_id, event_type, value from events")
def log_roundtrip(spark, d):
    """Events appended twice to a log of JSON lines, and read from all its files: each is there once."""
    path = f"{shared_dir(spark)}/log"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_events(events, path)
    sinks.append_events(events, path)
    return sources.event_log(spark, path, "event_id long, user_id long, event_type string, value double")[0]


@query("select n_nationkey, n_name, n_regionkey, 'parsed_table' as status from nation")
def file_roundtrip(spark, d):
    """A table as delimited files, found in their folder and parsed as files of unknown content."""
    path = f"{shared_dir(spark)}/files"
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=False)
    read = files.read_files(spark, path, "*.csv")
    cell = lambda i: F.get("cells", F.lit(i))
    return read.select("status", F.explode("rows").alias("cells")).select(cell(0).cast("long").alias("n_nationkey"), cell(1).alias("n_name"), cell(2).cast("long").alias("n_regionkey"), "status")


@query("""
select o_orderkey, o_totalprice from orders order by case when o_orderkey = 1 then 0 else 1 end, sha256('7:' || o_orderkey), o_orderkey limit 20""")
def acceptance_sample(spark, d):
    """20 orders by a seeded hash, order 1 always among them. Limited because that is the operator."""
    return evaluate.sampled(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20, 7, F.col("o_orderkey") == 1)
