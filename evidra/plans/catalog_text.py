"""Queries over text, pages and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidra.functions import scalars, text
from evidra.operators import pages, predicates
from evidra.plans.registry import query, quoted
from evidra.sources import table

#: Parameters of the queries: words that the given tables hold. The operators' own are those of procurement notices.
TOPICS = (("licences", ("Licensed", "Apache", "Copyright")), ("secrets", ("password", "token", "secret")), ("abuse", ("stupid", "worthless", "trash", "idiot")))
HINT_WORDS = ("the", "and", "que", "der", "les", "Licensed", "password", "Version")
_SPACE = r"[ \t\n\r\x0b\x0c]+"
_CLEAN = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_SPLIT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: length(s) >= 12)"


# dates, durations, numbers


@query("""
with t as (select o_orderkey, o_orderdate, cast(100 + o_orderkey % 100 as varchar) as y2, cast(month(o_orderdate) as varchar) as m, cast(day(o_orderdate) + o_orderkey % 3 as varchar) as dd from orders),
s as (select o_orderkey, '20' || y2[2:3] || '-' || m || '-' || dd as a, cast('20' || y2[2:3] as int) as y, cast(m as int) as m, cast(dd as int) as dd from t)
select o_orderkey, case when dd <= day(last_day(make_date(y, m, 1))) then strftime(make_date(y, m, dd), '%Y-%m-%d') end as normal, a || ',' || a as found from s""")
def date_facts(spark, d):
    year = F.concat(F.lit("20"), F.substring((100 + F.col("o_orderkey") % 100).cast("string"), 2, 2))
    written = F.concat_ws("-", year, F.month("o_orderdate").cast("string"), (F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 3).cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("from "), written, F.lit(" (again "), written, F.lit(")")).alias("s"))
    return rows.select("o_orderkey", scalars.normal_date(F.col("s")).alias("normal"), F.array_join(scalars.dates(F.col("s")), ",").alias("found"))


@query("""
select l_orderkey, l_linenumber, count(*) as n, min('P' || cast(cast(l_quantity as bigint) as varchar) || case l_returnflag when 'R' then 'Y' when 'A' then 'M' else 'D' end) as duration,
 min('P' || rtrim(cast(cast(l_quantity as bigint) as varchar), '0') || case l_returnflag when 'R' then 'Y' when 'A' then 'M' else 'D' end) as legacy from lineitem group by 1, 2""")
def durations(spark, d):
    said = F.concat(F.lit("within "), F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_returnflag") == "R", "年").when(F.col("l_returnflag") == "A", "个月").otherwise("天"))
    rows = table(spark, d, "lineitem").withColumn("s", said)
    duration, legacy = scalars.normal_duration(F.col("s")), scalars.normal_duration(F.col("s"), legacy=True)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min(duration).alias("duration"), F.min(legacy).alias("legacy"))


@query("select event_id, ts as as_utc, ts - interval 8 hour as from_offset, cast(null as timestamp) as of_none from events")
def iso_times(spark, d):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = lambda c: scalars.iso_timestamp(c)
    return table(spark, d, "events").select("event_id", at(plain).alias("as_utc"), at(F.concat(plain, F.lit("+08:00"))).alias("from_offset"), at(F.lit("none")).alias("of_none"))


@query("select l_orderkey, l_linenumber, count(*) as n, true as by_itself, false as part_only from lineitem group by 1, 2")
def whole_numbers(spark, d):
    q = F.col("l_quantity").cast("long")
    line = F.concat(F.lit("row "), (q * 10).cast("string"), F.lit(" and "), q.cast("string"), F.lit(".00 of "), F.col("l_suppkey").cast("string"))
    inside = F.concat(F.lit("row 7"), q.cast("string"), F.lit(" and "), q.cast("string"), F.lit("5"))
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(scalars.has_number(line, q.cast("string"))).alias("by_itself"), F.bool_or(scalars.has_number(inside, q.cast("string"))).alias("part_only")
    )


@query("""
select event_id, case when event_type = 'purchase' then 100 when value <= 5 then cast(floor(35 + greatest(value, 0) * 2) as bigint) when value <= 20 then cast(floor(45 + (value - 5) / 15 * 20) as bigint)
 when value <= 60 then cast(floor(65 + (value - 20) / 40 * 17) as bigint) when value <= 180 then cast(floor(82 + (value - 60) / 120 * 8) as bigint) else 90 end as percent from events""")
def run_progress(spark, d):
    return table(spark, d, "events").select("event_id", scalars.progress_percent(F.col("event_type") == "purchase", F.col("value")).alias("percent"))


@query("""
select conv_id, turn, cast(100 - case when contains(text, 'error') or contains(text, 'sorry') then 35 else 0 end - case when contains(text, '?') then 10 else 0 end
 - case when length(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g')) < 120 then 15 else 0 end - case when role = 'assistant' then 0 else 25 end as bigint) as score from conversations""")
def acceptance_scores(spark, d):
    score = scalars.acceptance_score(F.col("text"), F.col("role") == "assistant", ("error", "sorry"), "?", 120)
    return table(spark, d, "conversations").select("conv_id", "turn", score.alias("score"))


# identity


@query("select c_custkey, sha256(to_json({'name': c_name, 'nation': c_nationkey, 'segment': c_mktsegment})) as record_hash, length(to_json({'name': c_name, 'nation': c_nationkey, 'segment': c_mktsegment})) + 5 as n_chars from customer")
def record_hashes(spark, d):
    fields = {"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "nation": F.col("c_nationkey")}
    return table(spark, d, "customer").select("c_custkey", text.canonical_hash(fields).alias("record_hash"), text.json_chars(fields).alias("n_chars"))


# predicates


@query("""
select page_id, regexp_matches(url, '^https?://[^/\\s]+') as valid, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') as for_log,
 regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as normal from pages""")
def url_guards(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", predicates.valid_url(url).alias("valid"), predicates.url_host(url).alias("host"), predicates.url_for_log(url).alias("for_log"), predicates.normal_url(url).alias("normal")
    )


@query("""
select event_id, regexp_matches('run_' || event_id || '_' || event_type, '^run_[A-Za-z0-9_-]{1,80}$') as run_ok, regexp_matches('pack_' || event_id, '^pack_[A-Za-z0-9_-]{1,80}$') as pack_ok,
 regexp_matches('run_' || props, '^run_[A-Za-z0-9_-]{1,80}$') as other_ok from events""")
def id_guards(spark, d):
    safe = predicates.safe_id
    return table(spark, d, "events").select(
        "event_id", safe(F.concat(F.lit("run_"), F.col("event_id"), F.lit("_"), "event_type"), "run").alias("run_ok"), safe(F.concat(F.lit("pack_"), F.col("event_id")), "pack").alias("pack_ok"), safe(F.concat(F.lit("run_"), "props"), "run").alias("other_ok")
    )


@query("""
select p_partkey, case when contains(p_type, 'STEEL') then 'metal' when contains(p_type, 'COPPER') then 'metal' when contains(p_type, 'BRASS') then 'alloy' when contains(p_type, 'TIN') then 'metal' else 'other' end as business_type,
 contains(p_type, 'STEEL') or contains(p_type, 'COPPER') or contains(p_type, 'BRASS') or contains(p_type, 'TIN') as core from part""")
def core_kinds(spark, d):
    kind = predicates.first_keyword(F.col("p_type"), (("STEEL", "metal"), ("COPPER", "metal"), ("BRASS", "alloy"), ("TIN", "metal")), "other")
    return table(spark, d, "part").select("p_partkey", kind.alias("business_type"), (kind != "other").alias("core"))


@query("""
with f as (select user_id, list(distinct event_type) as kinds, arg_max(event_type, (ts, event_id)) as kind, sum(length(props)) as chars from events group by 1)
select user_id, kind in ('purchase', 'signup') or list_has_any(kinds, ['purchase', 'signup']) as any_usable, case when kind in ('error') then false else kind in ('purchase', 'signup') or list_has_any(kinds, ['purchase', 'signup']) end as final_usable,
 kind in ('error', 'click') as unavailable from f""")
def usable_children(spark, d):
    good, bad = ("purchase", "signup"), ("error",)
    f = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return f.select(
        "user_id", predicates.usable(F.col("kind"), F.col("kinds"), good).alias("any_usable"), predicates.usable(F.col("kind"), F.col("kinds"), good, bad).alias("final_usable"), F.col("kind").isin("error", "click").alias("unavailable")
    )


@query(f"""
with h as (select doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) as n, list_filter([{quoted(HINT_WORDS)}], lambda k: contains(text, k)) as k from documents)
select doc_id, len(k) as n_hints, array_to_string(k, ',') as hints, len(k) >= 4 and n >= 300 as rich, n < 120 as fragmentary from h""")
def evidence_hints(spark, d):
    t = F.col("text")
    found = text.hits(t, HINT_WORDS)
    return table(spark, d, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n_hints"), F.array_join(found, ",").alias("hints"), predicates.rich(t, HINT_WORDS).alias("rich"), predicates.fragmentary(t, 120).alias("fragmentary")
    )


# text


@query("select doc_id, length(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c\\-/.]+', '', 'g')) as n_match, sha256(lower(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c\\-/.]+', '', 'g'))) as match_hash from documents")
def comparison_text(spark, d):
    m = text.match_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(m).cast("long").alias("n_match"), F.sha2(m, 256).alias("match_hash"))


@query(f"""
with s as (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, {_SPLIT} as a from documents)),
t as (select unnest([{", ".join(f"{{'topic': '{n}', 'words': [{quoted(w)}]}}" for n, w in TOPICS)}], recursive := true)),
f as (select doc_id, topic, s, i, row_number() over (partition by doc_id, topic order by i) as r from s, t where len(list_filter(words, lambda w: contains(s, w))) > 0),
m as (select doc_id, topic, min(i) as first_at, left(string_agg(s, '; ' order by i), 500) as section from f where r <= 3 group by 1, 2)
select doc_id, topic, section, cast(row_number() over (partition by doc_id order by first_at, topic) as bigint) as place from m qualify row_number() over (partition by doc_id order by first_at, topic) <= 12""")
def important_sections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "s"))
    named = rows.select("doc_id", "i", "s", F.explode(F.array(*[F.struct(F.lit(n).alias("topic"), (F.size(text.hits(F.col("s"), w)) > 0).alias("yes")) for n, w in TOPICS])).alias("x"))
    found = named.where("x.yes").select("doc_id", "x.topic", "i", "s")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy("i"))).where("r <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x.s), "; ")
    sections = first.groupBy("doc_id", "topic").agg(F.min("i").alias("first_at"), F.substring(joined, 1, 500).alias("section"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_at", "topic"))
    return sections.withColumn("place", place.cast("long")).where("place <= 12").select("doc_id", "topic", "section", "place")


_SQL_NAMED = ", ".join(f"case when len(list_filter(s, lambda x: len(list_filter([{quoted(w)}], lambda k: contains(x, k))) > 0)) > 0 then '{n}: ' || left(array_to_string(list_filter(s, lambda x: len(list_filter([{quoted(w)}], lambda k: contains(x, k))) > 0)[1:3], '; '), 500) end" for n, w in TOPICS)


@query(f"""
with d as (select doc_id, {_SPLIT} as s from documents), n as (select doc_id, s, list_filter([{_SQL_NAMED}], lambda x: x is not null) as named from d),
r as (select doc_id, named, list_filter(s, lambda x: (contains(x, 'Version') or contains(x, 'with')) and len(list_filter(named, lambda p: contains(p, x))) = 0) as rest from n)
select doc_id, array_to_string(list_concat(named, list_transform(rest, lambda x: left(x, 500)))[1:12], ' / ') as parts, least(12, len(named) + len(rest)) as n from r""")
def important_parts(spark, d):
    parts = text.important_parts(F.col("text"), TOPICS, ("Version", "with"))
    return table(spark, d, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.array_join("p", " / ").alias("parts"), F.size("p").cast("long").alias("n"))


@query(r"""
with s as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '([.!?;])\s*', '\1' || chr(1), 'g'), '[^\x01\n]+')) as p from documents)
select doc_id, count(*) as n, max(length(trim(p))) as longest, count(*) filter (regexp_matches(trim(p), '[.!?;]$')) as ended from s where length(trim(p)) >= 12 group by 1""")
def sentences_with_ends(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.kept_sentences(F.col("text"), ".!?;", 12)).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"), F.count_if(F.col("s").rlike("[.!?;]$")).alias("ended"))


@query("""
select page_id, length(t) as n_chars, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[./:_-][A-Za-z0-9]+)*')) as n_words from (select page_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 html, '<[^>]+>', '', 'g'), '```.*?```', ' ', 'gs'), '`([^`]*)`', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '(?m)^[#>\\-*+\\s]+', '', 'g'), '|', ' '), '[*_~]+', '', 'g') as t from pages)""")
def page_words(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.length(text.visible_text(h)).cast("long").alias("n_chars"), text.reader_words(h).alias("n_words"))


@query("""
select conv_id, turn, case role when 'assistant' then trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) else '' end as answer from conversations""")
def model_answers(spark, d):
    wrapped = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>\nlet me see </b> </think>\n```text\n"), "text", F.lit("\n```"))).otherwise(F.concat(F.lit("<thinking>never closed "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.answer_text(wrapped).alias("answer"))


@query("""
select p_partkey, left(trim(regexp_replace(regexp_replace(p_name || '/' || p_brand || ': ' || p_type || '?', '[\\\\/:*?"<>|]+', '_', 'g'), '[ ]+', ' ', 'g'), ' ._'), 80) as file_name,
 count(*) over (partition by left(trim(regexp_replace(regexp_replace(p_brand || '/' || p_type, '[\\\\/:*?"<>|]+', '_', 'g'), '[ ]+', ' ', 'g'), ' ._'), 80)) > 1 as taken from part""")
def report_names(spark, d):
    name = text.file_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit(": "), "p_type", F.lit("?")))
    shared = text.file_name(F.concat("p_brand", F.lit("/"), "p_type"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("file_name"), shared.alias("shared"))
    n = rows.groupBy("shared").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "shared").select("p_partkey", "file_name", (F.col("n") > 1).alias("taken"))


@query(f"""
with t as (select conv_id, coalesce(string_agg(text, chr(10) || chr(10) order by turn), '') as t from conversations where trim(text) <> '' group by 1)
select conv_id, case when length(t) <= 300 then t else left(t, 195) || ' [...] ' || right(t, 105) end as input_text from t""")
def model_inputs(spark, d):
    turns = table(spark, d, "conversations").where(F.trim("text") != "").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("t"))
    return turns.select("conv_id", text.within_chars([F.array_join("t", "\n\n")], 300).alias("input_text"))


@query("select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title, regexp_matches(lower(html), 'type=\"?password|name=\"?passw|login|sign in') as login_page from pages")
def login_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"), predicates.login_page(F.col("html")).alias("login_page"))


# facts of documents

_REGION_NAMES = ("src1", "src2", "src5", "en", "fr")


@query(f"""
with t as (select doc_id, {_CLEAN} as c, text from documents),
m as (select doc_id, 'title' as name, regexp_extract(c, '^(.{{4,120}})', 1) as value from t union all select doc_id, 'licence', regexp_extract(c, '(Licensed under [^.]{{4,40}})', 1) from t union all select doc_id, 'number', regexp_extract(c, '([0-9]{{3,}})', 1) from t)
select doc_id, name, value from m where value <> ''""")
def mandatory_facts(spark, d):
    patterns = (("title", "^(.{4,120})"), ("licence", "(Licensed under [^.]{4,40})"), ("number", "([0-9]{3,})"))
    rows = table(spark, d, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("c"))
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("c", p, 1).alias("value")) for n, p in patterns])
    return rows.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("value <> ''")


@query(f"select doc_id, array_to_string(list_filter([{quoted(_REGION_NAMES)}], lambda r: contains(' ' || source || ' ' || lang || ' ', ' ' || r || ' ')), ',') as regions from documents")
def region_hits(spark, d):
    """Regions that a record names as whole tokens, as listed."""
    tokens = F.array("source", "lang")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, _REGION_NAMES)), lambda r: F.array_contains(tokens, r)), ",").alias("regions"))


@query(f"""
with s as (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, {_SPLIT} as a from documents)),
r as (select doc_id, s, row_number() over (partition by doc_id order by i) as place from s where contains(s, 'Licensed') or contains(s, 'password') or contains(s, 'the'))
select doc_id, cast(place as bigint) as place, case when length(s) <= 260 then s else left(s, 169) || ' [...] ' || right(s, 91) end as rule from r where place <= 40""")
def key_rules(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.filter(text.sentences(F.col("text")), lambda s: F.contains(s, F.lit("Licensed")) | F.contains(s, F.lit("password")) | F.contains(s, F.lit("the"))).alias("a"))
    return rows.select("doc_id", F.posexplode(F.slice("a", 1, 40)).alias("i", "s")).select("doc_id", (F.col("i") + 1).cast("long").alias("place"), text.truncate_head_tail(F.col("s"), 260).alias("rule"))


# pages

def _plain(c: str) -> str:
    for tag in ("script", "style", "noscript", "svg"):
        c = f"regexp_replace({c}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gs')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'gs')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{sign}')"
    return f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"


def _in(tag: str) -> str:
    return _plain(f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)")


@query(f"""
with p as (select page_id, {_in('h1')} as h, {_in('title')} as t, {_in('article')} as a, coalesce(nullif({_in('body')}, ''), {_plain('html')}) as b from pages)
select page_id, case when h <> '' then h else t end as title, sha256(case when length(a) >= 600 then a else b end) as main_hash, length(case when length(a) >= 600 then a else b end) as main_chars from p""")
def page_main(spark, d):
    main = pages.main_text(F.col("html"), classes=("article-content",), least=600)
    return table(spark, d, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"), F.sha2(main, 256).alias("main_hash"), F.length(main).cast("long").alias("main_chars"))


@query(f"""
with a as (select page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) as h, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) as t from pages),
u as (select page_id, url, unnest(h) as href, {_plain('unnest(t)')} as said, generate_subscripts(h, 1) as i from a),
r as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href as link, said, i from u where href like '/%' and (contains(said, 'th') or contains(said, 'er') or contains(said, 'que')) and said not in ('the', 'er', 'que')),
f as (select page_id, link, min((i, said)) as x from r group by 1, 2)
select page_id, row_number() over (partition by page_id order by x[1]) as place, link, x[2] as said from f qualify row_number() over (partition by page_id order by x[1]) <= 3""")
def file_links(spark, d):
    return pages.file_links(table(spark, d, "pages"), "page_id", "url", "html", (".pdf",), ("th", "er", "que"), ("the", "er", "que"), 3)
