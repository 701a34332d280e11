"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidra.functions import scalars, text
from evidra.operators import budgets, claims, evidence, history, records, tables
from evidra.plans.registry import QUERIES, SQL, query, quoted
from evidra.sources import table
from evidra.streaming import fold

# Parameters of the queries (the operators take them as arguments).
KEYWORDS = ("the", "license", "que", "der", "password", "apache")
PHRASES = ("Apache License", "password", "worthless", "stupid", "trash")


_SQL_SPACE = r"[ \t\n\r\x0b\x0c]+"
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: length(s) >= 12)"

# records


@query("""
with c as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_orderkey, o_orderpriority, o_orderdate, o_totalprice, coalesce(n, 0) as n_children from orders left join c on l_orderkey = o_orderkey
where o_orderstatus = 'O' and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1997-12-31 23:59:59' and o_orderpriority like '%-%'
order by case when o_orderpriority = '1-URGENT' then 0 else 1 end, o_orderdate desc, o_orderkey limit 50 offset 50""")
def records_page(spark, d):
    found = records.search(
        table(spark, d, "orders"),
        [F.col("o_orderstatus") == "O", F.col("o_orderdate").between(F.to_timestamp(F.lit("1995-01-01")), F.to_timestamp(F.lit("1997-12-31 23:59:59"))), F.col("o_orderpriority").like("%-%")],
    )
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_orderdate"), F.col("o_orderkey")]
    shown = records.page(found, order, 2, 50)  # the order needs no counts, so only the children of one page are counted
    counted = records.child_counts(shown, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", few=True)
    return counted.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", "n_children")


@query("select count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as pages from orders where o_orderstatus = 'O'")
def records_count_pages(spark, d):
    return records.page_count(records.search(table(spark, d, "orders"), [F.col("o_orderstatus") == "O"]), 50)


def _details(parents, children):
    rows = parents.join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    child = F.when(F.col("l_orderkey").isNotNull(), F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey)), ",")
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("n_children"), said.alias("children"))


@query("""
select o_orderkey, o_orderstatus, count(l_orderkey) as n_children, coalesce(string_agg(cast(l_linenumber as varchar) || ':' || cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey, l_suppkey), '') as children
from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def record_detail(spark, d):
    return _details(table(spark, d, "orders"), table(spark, d, "lineitem"))


_CHOSEN = "(values ('primary', 1), ('primary', 2), ('auxiliary', 2), ('auxiliary', 3), ('auxiliary', 999999999)) as c(role, o_orderkey)"


@query(f"""
with c as (select role, cast(o_orderkey as bigint) as o_orderkey from {_CHOSEN})
select role, o_orderkey, exists (select 1 from orders o where o.o_orderkey = c.o_orderkey) as found, (select count(distinct role) from c x where x.o_orderkey = c.o_orderkey) > 1 as overlaps from c""")
def selection_preview(spark, d):
    chosen = spark.createDataFrame([("primary", 1), ("primary", 2), ("auxiliary", 2), ("auxiliary", 3), ("auxiliary", 999999999)], "role string, o_orderkey long")
    return records.selection_report(table(spark, d, "orders"), chosen, "o_orderkey")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, place from (select *, row_number() over (partition by l_orderkey order by case when l_returnflag = 'R' then 0 else 1 end,
 l_linenumber, l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) as place from lineitem) where place <= 3""")
def order_attachment_rank(spark, d):
    order = [F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.col("l_linenumber"), F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return records.first_children(table(spark, d, "lineitem"), "l_orderkey", order, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


# text and pages

_SQL_HTML = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _SQL_HTML = f"regexp_replace({_SQL_HTML}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gs')"
_SQL_HTML = f"regexp_replace({_SQL_HTML}, '<[^>]*>', ' ', 'gs')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _SQL_HTML = f"replace({_SQL_HTML}, '{_name}', '{_sign}')"
_SQL_HTML = f"trim(regexp_replace({_SQL_HTML}, '{_SQL_SPACE}', ' ', 'g'))"


@query(f"select page_id, {_SQL_HTML} as clean, length({_SQL_HTML}) as n_chars from pages")
def html_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("clean")).withColumn("n_chars", F.length("clean").cast("long"))


@query(r"select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title, length(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)) as main_chars from pages")
def html_title_main(spark, d):
    part = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, d, "pages").select("page_id", F.trim(part("(?s)<title>(.*?)</title>")).alias("title"), F.length(part("(?s)<article[^>]*>(.*?)</article>")).cast("long").alias("main_chars"))


@query(r"""
select page_id, link, min(i) as place from (select page_id, unnest(a) as link, generate_subscripts(a, 1) as i from (select page_id, regexp_extract_all(html, 'href="([^"#]+)"', 1) as a from pages)) group by 1, 2""")
def link_discovery(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(links).alias("i", "link"))
    return rows.groupBy("page_id", "link").agg((F.min("i") + 1).cast("long").alias("place"))


@query(f"select doc_id, i as sentence_no, s as sentence from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, {_SQL_SENTENCES} as a from documents))")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("sentence_no"), "sentence")


@query(f"""
with s as (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, {_SQL_SENTENCES} as a from documents)),
h as (select *, list_filter([{quoted(KEYWORDS)}], lambda k: contains(lower(s), k)) as k from s)
select doc_id, i as sentence_no, left(s, 280) as passage, array_to_string(k[1:3], ',') as reason from h where len(k) > 0""")
def keyword_passages(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "s"))
    found = rows.withColumn("k", text.hits(F.lower("s"), KEYWORDS)).where(F.size("k") > 0)
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("sentence_no"), F.substring("s", 1, 280).alias("passage"), F.array_join(F.slice("k", 1, 3), ",").alias("reason"))


@query(f"""
with s as (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, {_SQL_SENTENCES} as a from documents)),
t as (select doc_id, topic, s, i, row_number() over (partition by doc_id, topic order by i) as r from s, (select unnest([{quoted(KEYWORDS)}]) as topic) where contains(lower(s), topic))
select doc_id, topic, left(string_agg(s, ' / ' order by i), 260) as summary, count(*) as n from t where r <= 3 group by 1, 2""")
def topic_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "s"))
    named = rows.select("doc_id", "i", "s", F.explode(text.hits(F.lower("s"), KEYWORDS)).alias("topic"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy("i"))).where("r <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x.s), " / ")
    return first.groupBy("doc_id", "topic").agg(F.substring(joined, 1, 260).alias("summary"), F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when length(text) <= 200 then text else left(text, 130) || ' [...] ' || right(text, 70) end as cut from documents")
def truncate_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_head_tail(F.col("text"), 200).alias("cut"))


@query("select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) as n_words, length(text) as n_visible from documents")
def visible_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.latin_words(F.col("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_visible"))


@query(f"select doc_id, phrase, cast(position(phrase in text) as bigint) as place from documents, (select unnest([{quoted(PHRASES)}]) as phrase) where contains(text, phrase)")
def forbidden_scan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(text.hits(F.col("text"), PHRASES)).alias("phrase"))
    return rows.select("doc_id", "phrase", F.instr("text", F.col("phrase")).cast("long").alias("place"))


@query(f"""
select doc_id, array_to_string(list_filter({_SQL_SENTENCES}, lambda s: not ({" or ".join(f"contains(s, '{p}')" for p in PHRASES)})), '. ') as body,
 len(list_filter({_SQL_SENTENCES}, lambda s: {" or ".join(f"contains(s, '{p}')" for p in PHRASES)})) as removed from documents""")
def sanitize_doc(spark, d):
    bad = lambda s: F.exists(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(s, p))
    rows = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.array_join(F.filter("s", lambda s: ~bad(s)), ". ").alias("body"), F.size(F.filter("s", bad)).cast("long").alias("removed"))


# facts and evidence

_FACTS = (("number", "[0-9]+(?:\\.[0-9]+)?"), ("email", "[a-z0-9.]+@[a-z0-9.]+"), ("license", "Licensed under [A-Za-z0-9 -]+"))


@query(
    "with f as ("
    + " union all ".join(f"select doc_id, '{k}' as kind, {n} as o, unnest(list_distinct(regexp_extract_all(text, '{p}'))) as value from documents" for n, (k, p) in enumerate(_FACTS))
    + ") select doc_id, kind, count(*) as n, min(value) as first_value, max(value) as last_value from f group by 1, 2"
)
def key_facts(spark, d):
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("v")) for k, p in _FACTS])
    rows = table(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.kind", F.explode("x.v").alias("value"))
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


@query("""
select c_custkey, field, value from (select c_custkey, c_name, c_mktsegment, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
unpivot (value for field in (c_name, c_mktsegment, n_name, r_name)) where value <> ''""")
def structured_field_facts(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.unpivot("c_custkey", ["c_name", "c_mktsegment", "n_name", "r_name"], "field", "value").where("value <> ''")


@query(f"select doc_id, sha256(trim(regexp_replace(text, '{_SQL_SPACE}', ' ', 'g'))) as source_hash from documents")
def source_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapse_space(F.col("text")), 256).alias("source_hash"))


@query("select sha256(text) as content_hash, min(doc_id) as first_doc, count(*) as copies from documents group by 1")
def content_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("""
with i as (select sha256(concat_ws(chr(31), 'text', lang, text)) as item_id, doc_id, lang, source from documents)
select item_id, min(doc_id) as doc_id, count(*) as seen from i group by 1""")
def evidence_items(spark, d):
    items = table(spark, d, "documents").withColumn("item_id", evidence.item_id(F.lit("text"), F.col("lang"), F.col("text")))
    return items.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("seen"))


def _items(spark, d):
    """Parts are direct evidence, orders derive from the parts of their lines; some of each are made faulty by their keys."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "P", "A").otherwise("B").alias("level"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("item"), F.when(F.col("p_size") > 40, "C").otherwise("A").alias("level"))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("item"), F.concat(F.lit("p"), F.col("l_partkey") * 2).alias("source")).distinct()
    return orders.unionByName(parts), links


_SQL_ITEMS = """items as (select 'o' || o_orderkey as item, case when o_orderstatus = 'P' then 'A' else 'B' end as level from orders
 union all select 'p' || p_partkey, case when p_size > 40 then 'C' else 'A' end from part),
links as (select distinct 'o' || l_orderkey as item, 'p' || (l_partkey * 2) as source from lineitem)"""


@query(f"""
with {_SQL_ITEMS}, h as (select l.item, bool_or(i.level is null) as lost, bool_or(coalesce(i.level = 'A', false)) as direct from links l left join items i on i.item = l.source group by 1),
p as (select i.item, case when i.level = 'B' and not coalesce(direct, false) then 'no_direct_source' when coalesce(lost, false) then 'missing_source' when i.level = 'A' and h.item is not null then 'direct_with_source' end as problem
from items i left join h on h.item = i.item) select item, problem from p where problem is not null""")
def evidence_violations(spark, d):
    return evidence.violations(*_items(spark, d))


@query("""
with f as (select p_brand, p_type, cast(p_size as varchar) as value from part)
select p_brand, p_type, count(distinct value) as values_seen, count(*) as candidates, count(distinct value) > 1 as conflict, case when count(distinct value) = 1 then min(value) end as kept_value from f group by 1, 2""")
def fact_conflicts(spark, d):
    facts = table(spark, d, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("value"))
    return evidence.conflicts(facts, ["p_brand", "p_type"], "value")


@query("""
with recursive l as (select distinct 'o' || l_orderkey as item, 's' || l_suppkey as source from lineitem union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
c(item) as (select 'o' || o_orderkey from orders where o_orderstatus = 'F' union select l.source from c join l on l.item = c.item) select item from c""")
def mandatory_closure(spark, d):
    return _closure(spark, d, "o_orderstatus = 'F'")


def _closure(spark, d, mandatory):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    links = table(spark, d, "lineitem").select(key("o", "l_orderkey").alias("item"), key("s", "l_suppkey").alias("source"))
    links = links.union(table(spark, d, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"))).union(table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    return evidence.closure(table(spark, d, "orders").where(mandatory).select(key("o", "o_orderkey").alias("item")), links)


@query(f"with {_SQL_ITEMS}, b as (select item from items where level = 'B') select item from b union select source as item from links where item in (select item from b)")
def protected_set(spark, d):
    items, links = _items(spark, d)
    derived = items.where("level = 'B'").select("item")
    return derived.union(links.join(derived, "item", "left_semi").select("source")).distinct()


@query("""
with r as (select source, doc_id, length(text) as size, sum(length(text)) over (partition by source order by length(text) desc, doc_id rows unbounded preceding) as running from documents)
select source, doc_id, size, cast(running as bigint) as running from r where running <= 80000""")
def budgeted_evidence(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return budgets.within_budget(rows.withColumn("shorter", -F.col("size")), "source", "shorter", ["doc_id"], "size", 80_000).drop("shorter")


@query("""
with r as (select source, doc_id, length(text) > 2000 as mandatory, sum(length(text)) over (partition by source order by length(text) desc, doc_id rows unbounded preceding) <= 80000 as kept from documents)
select source, count(*) filter (mandatory) as mandatory_items, count(*) filter (mandatory and kept) as retained,
 round_even(count(*) filter (mandatory and kept) / nullif(count(*) filter (mandatory), 0), 6) as retention from r group by 1""")
def retention(spark, d):
    before = table(spark, d, "documents").select("source", "doc_id", (F.length("text") > 2000).alias("mandatory"))
    return evidence.retention(before, budgeted_evidence(spark, d), "source", "doc_id")


# claims

#: Terms and markers of the queries; the operator's own are those of procurement notices.
CLAIM_TERMS, CLAIM_MARKS = ("license", "apache", "password", "worthless", "the", "que"), "[0-9]{3,}"

_SQL_CLEAN = f"trim(regexp_replace(text, '{_SQL_SPACE}', ' ', 'g'))"
_SQL_HAS = f"list_filter([{quoted(CLAIM_TERMS)}], lambda k: contains({_SQL_CLEAN}, k))"
_SQL_INDEX = f"""c as (select item_id as claim, {_SQL_CLEAN} as t, list_distinct(regexp_extract_all(text, '{CLAIM_MARKS}')) as m, {_SQL_HAS} as k from benchmark),
e as (select doc_id as evidence, {_SQL_CLEAN} as t, {_SQL_HAS} as k from documents),
b as (select claim, evidence, c.t as ct, e.t as et, m, list_filter(c.k, lambda x: list_contains(e.k, x)) as k from c, e where c.t <> '' and e.t <> ''),
v as (select claim, evidence, case when contains(et, ct) then 100 when length(et) <= 500 and contains(ct, et) then 95 when len(list_filter(m, lambda x: not contains(et, x))) > 0 then 0
 when len(m) > 0 then case when len(k) > 0 then 80 + least(10, len(k)) else 0 end
 when len(k) >= 2 or len(list_filter(k, lambda x: length(x) >= 4)) > 0 then 60 + least(20, 3 * len(k)) else 0 end as score from b),
x as (select claim, evidence, cast(score as bigint) as score from (select *, max(score) over (partition by claim) as best from v where score > 0) where score = best or score >= 90)"""


@query(f"with {_SQL_INDEX} select claim, evidence, score from x")
def claim_index(spark, d):
    marks = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(CLAIM_MARKS), F.lit(0)))
    return claims.claim_index(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", terms=CLAIM_TERMS, normalise=text.collapse_space, markers=marks)


@query(f"""
with {_SQL_INDEX}, p as (select claim, count(*) as links from x group by 1)
select count(*) as claims, count(links) as supported, cast(coalesce(sum(links), 0) as bigint) as links, coalesce(round(count(links) / nullif(count(*), 0), 6), 1.0) as support_rate from benchmark left join p on claim = item_id""")
def claim_metrics(spark, d):
    return claims.support(table(spark, d, "benchmark"), claim_index(spark, d), "item_id")


_SQL_TURNS = f"""t as (select conv_id, role, string_agg(text, ' ' order by turn) as text from conversations group by 1, 2),
a as (select conv_id, unnest(list_distinct(regexp_extract_all({_SQL_LOWER}, '[a-z]{{9,}}'))) as term from t where role = 'assistant'),
u as (select conv_id, unnest(list_distinct(regexp_extract_all({_SQL_LOWER}, '[a-z]{{9,}}'))) as term from t where role = 'user')"""


def _turn_terms(spark, d, role):
    rows = table(spark, d, "conversations").where(F.col("role") == role)
    return rows.select("conv_id", F.explode(text.terms(F.col("text"), 9)).alias("term")).distinct()


@query(f"with {_SQL_TURNS} select conv_id, term from a except select conv_id, term from u")
def source_fidelity(spark, d):
    return _turn_terms(spark, d, "assistant").join(_turn_terms(spark, d, "user"), ["conv_id", "term"], "left_anti")


@query(f"""
with {_SQL_TURNS}, m as (select u.conv_id, count(*) as total, count(a.term) as covered from u left join a on a.conv_id = u.conv_id and a.term = u.term group by 1)
select c.conv_id, coalesce(total, 0) as total, coalesce(covered, 0) as covered, cast(coalesce(round_even(100.0 * covered / total, 0), 100) as bigint) as score from (select distinct conv_id from conversations) c left join m using (conv_id)""")
def coverage_score(spark, d):
    said = _turn_terms(spark, d, "assistant").withColumn("yes", F.lit(1))
    found = _turn_terms(spark, d, "user").join(said, ["conv_id", "term"], "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count("yes").alias("covered"))
    both = table(spark, d, "conversations").select("conv_id").distinct().join(found, "conv_id", "left")
    score = F.coalesce(F.bround(100.0 * F.col("covered") / F.col("total")), F.lit(100)).cast("long")
    return both.select("conv_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("covered", F.lit(0)).alias("covered"), score.alias("score"))


@query(f"""
with tok as (select doc_id, unnest(regexp_extract_all({_SQL_LOWER}, '[a-z0-9]+')) as w from documents), c as (select doc_id, w, count(*) as n from tok group by 1, 2),
l as (select w, cast(sum(n) as bigint) as n from c join documents using (doc_id) where lang = 'en' group by 1), r as (select w, cast(sum(n) as bigint) as n from c join documents using (doc_id) where lang = 'fr' group by 1)
select cast(sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) as bigint) as shared, cast(sum(greatest(coalesce(l.n, 0), coalesce(r.n, 0))) as bigint) as total,
 round(sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) / sum(greatest(coalesce(l.n, 0), coalesce(r.n, 0))), 9) as jaccard from l full join r on l.w = r.w""")
def token_jaccard(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(text.lower_ascii(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    n = words.groupBy("w").agg(F.count_if(F.col("lang") == "en").alias("l"), F.count_if(F.col("lang") == "fr").alias("r"))
    low, high = F.sum(F.least("l", "r")), F.sum(F.greatest("l", "r"))
    return n.agg(low.alias("shared"), high.alias("total"), F.round(low / high, 9).alias("jaccard"))


# sizes, levels, strategies


@query("""
with s as (select source, cast(sum(length(text)) as bigint) as total, cast(sum(case when lang = 'en' then length(text) else 0 end) as bigint) as relevant, count(*) filter (length(text) > 40000) as primaries,
 count(*) filter (length(text) < 800) as brief, min(length(text)) < 60 as led, max(length(text)) > 38000 as heavy from documents group by 1),
l as (select *, case when total < 1000 then 'low' when total < 5000 then 'medium' when total < 12000 then 'high' else 'very_high' end as level,
 case when total <= 80000 then 'none' when total <= 90000 then 'light' when total <= 150000 then 'medium' else 'strong' end as tier,
 case when primaries >= 2 then 'staged_generation' when led then 'attachment_led' when heavy then 'table_heavy' when relevant <= 65000 then 'full_input' when relevant <= 75000 then 'light_compact'
  when relevant <= 80000 then 'safe_compact' else 'staged_generation' end as strategy from s)
select source, total, level, case level when 'low' then '600-1000' when 'medium' then '1000-1800' when 'high' then '1800-3000' else '3000+' end as report_length, tier,
 case tier when 'none' then total when 'light' then 78000 when 'medium' then 70000 else 75000 end as floor_chars, case tier when 'none' then total when 'light' then 79500 else 79000 end as ceiling_chars, strategy,
 case when strategy in ('attachment_led', 'table_heavy') then 'structure_based' when strategy = 'staged_generation' then 'complexity_based' else 'size_based' end as strategy_type,
 case when primaries = 1 and brief = 0 and led then '1500-2500' when primaries >= 2 or brief >= 2 then '3000-5000' else '1800-3000' end as target from l""")
def input_strategy(spark, d):
    n = F.length("text")
    s = table(spark, d, "documents").groupBy("source").agg(
        F.sum(n).cast("long").alias("total"), F.sum(F.when(F.col("lang") == "en", n).otherwise(0)).cast("long").alias("relevant"), F.count_if(n > 40_000).alias("primaries"),
        F.count_if(n < 800).alias("brief"), (F.min(n) < 60).alias("led"), (F.max(n) > 38_000).alias("heavy"),
    )
    total, level = F.col("total"), scalars.evidence_level(F.col("total"))
    strategy, window = scalars.input_strategy(F.col("primaries"), F.col("led"), F.col("heavy"), F.col("relevant")), scalars.tier_window(total)
    target = scalars.target_length(F.col("primaries"), F.col("brief"), F.lit(10_000), F.lit(1), F.col("led"))
    return s.select(
        "source", "total", level.alias("level"), scalars.report_length(level).alias("report_length"), scalars.compression_tier(total).alias("tier"), window.floor.alias("floor_chars"),
        window.ceiling.alias("ceiling_chars"), strategy.alias("strategy"), scalars.strategy_type(strategy).alias("strategy_type"), target.alias("target"),
    )


_PARTS = [(lang, quality) for lang in ("en", "fr", "de", "es") for quality in (1, 0)]
_SQL_PARTS = " + ".join(f"{w} * coalesce(sum(length(text)) filter (lang = '{lang}' and quality = {q}), 0)" for (lang, q), w in zip(_PARTS, scalars.WEIGHTS, strict=False))


@query(f"select source, cast(floor(({_SQL_PARTS} + {scalars.WEIGHTS[-1]} * coalesce(sum(length(text)) filter (quality is null), 0)) / 10) as bigint) as weighted from documents left join labels using (doc_id) group by 1")
def weighted_chars(spark, d):
    """Languages and labels stand for the nine parts of a pack."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.length("text")
    parts = [F.sum(F.when((F.col("lang") == lang) & (F.col("quality") == q), n)) for lang, q in _PARTS]
    return rows.groupBy("source").agg(scalars.weighted_chars([*parts, F.sum(F.when(F.col("quality").isNull(), n))]).alias("weighted"))


# tables


@query("""
with v as (select field, trim(value) as v from (select p_name, p_brand, p_type, cast(p_size as varchar) as p_size from part) unpivot (value for field in (p_name, p_brand, p_type, p_size)))
select field, count(*) as non_empty, count(distinct v) as distinct_values, min(try_cast(nullif(regexp_extract(v, '-?[0-9]+(?:\\.[0-9]+)?'), '') as double)) as least,
 max(try_cast(nullif(regexp_extract(v, '-?[0-9]+(?:\\.[0-9]+)?'), '') as double)) as most from v where v <> '' group by 1""")
def table_field_stats(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return tables.field_stats(rows.unpivot("p_partkey", ["p_name", "p_brand", "p_type", "p_size"], "field", "value"), "field", "value")


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 10")
def top_categories(spark, d):
    return tables.top_categories(table(spark, d, "part"), "p_brand", 10)


@query("""
with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as place, count(*) over (partition by p_brand) as n from part)
select p_brand, p_partkey, place from r where n <= 5 or place in (select cast(round_even(i * (n - 1) / 4.0, 0) as bigint) from range(5) t(i))""")
def spread_sample(spark, d):
    return tables.spread(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 5).select("p_brand", "p_partkey", F.col("at").cast("long").alias("place"))


@query("select p_partkey, p_name || ' | ' || p_brand || ' | ' || p_type || ' | ' || p_size as row_text from part")
def row_reassembly(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("col_no", "value"))
    return tables.reassemble(rows, ["p_partkey"], "col_no", "value")


# runs and events


@query("""
select user_id, count(*) as n, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type not in ('error', 'click')) as others,
 count(*) filter (value > 50) as large from events group by 1""")
def status_counters(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "click").alias("clicks"), F.count_if(~kind.isin("error", "click")).alias("others"), F.count_if(F.col("value") > 50).alias("large")
    )


@query("""
select user_id, n as revision, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r, count(*) over (partition by user_id) as n from events) where r = 1""")
def history_latest(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return history.latest(events, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "revision", "event_id", "event_type", "value")


@query("""
select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and contains(event_type, 'e') order by ts desc, user_id desc limit 20""")
def history_list(spark, d):
    last = history.latest(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")]).where(F.contains("event_type", F.lit("e")))
    return records.page(last, [F.desc("ts"), F.desc("user_id")], 1, 20).select("user_id", "event_id", "event_type", "ts")


@query("""
select event_id, user_id, last_value(case when value > 20 then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events""")
def history_carry_forward(spark, d):
    out = history.carry_forward(table(spark, d, "events"), "user_id", "ts", ["event_id"], "value", F.col("value") > 20, "carried")
    return out.select("event_id", "user_id", "carried")


@query("""
with f as (select user_id, first(event_type order by ts, event_id) as a_type, last(event_type order by ts, event_id) as b_type, first(props order by ts, event_id) as a_props, last(props order by ts, event_id) as b_props from events group by 1)
select user_id, 'event_type' as field, a_type as left_value, b_type as right_value from f where a_type is distinct from b_type union all select user_id, 'props', a_props, b_props from f where a_props is distinct from b_props""")
def run_compare(spark, d):
    events, order = table(spark, d, "events"), F.struct("ts", "event_id")
    ends = events.groupBy("user_id").agg(F.min_by(F.struct("event_type", "props"), order).alias("a"), F.max_by(F.struct("event_type", "props"), order).alias("b"))
    return history.differing(ends.select("user_id", "a.*"), ends.select("user_id", "b.*"), "user_id", ["event_type", "props"])


_STEPS = ("view", "click", "signup", "purchase", "error")


@query(f"""
with l as (select user_id, event_type, arg_max(value > 10, (ts, event_id)) as done from events group by 1, 2), h as (select user_id, list(event_type) filter (done) as held from l group by 1),
o as (select user_id, list_filter([{quoted(_STEPS)}], lambda s: not list_contains(coalesce(held, []), s)) as steps from h)
select user_id, len(steps) as open_steps, steps[1] as next_step from o""")
def resume_plan(spark, d):
    return history.resume_plan(table(spark, d, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], F.col("value") > 10, list(_STEPS))


@query("""
select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1""")
def latency_percentiles(spark, d):
    return history.percentiles(table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query("""
with m as (select event_type, event_id % 2 = 0 as candidate, value from events),
p as (select event_type, quantile_disc(value, 0.95) filter (candidate) as candidate_p95, quantile_disc(value, 0.95) filter (not candidate) as baseline_p95 from m group by 1)
select event_type, candidate_p95, baseline_p95, round(greatest(1.3 * baseline_p95, baseline_p95 + 30), 6) as allowed, candidate_p95 <= greatest(1.3 * baseline_p95, baseline_p95 + 30) as passed from p""")
def baseline_gate(spark, d):
    events = table(spark, d, "events").withColumn("candidate", F.col("event_id") % 2 == 0)
    p95 = lambda rows, name: history.percentiles(rows, "event_type", "value", (0.95,)).select("event_type", F.col("p95").alias(name))
    both = p95(events.where("candidate"), "candidate_p95").join(p95(events.where("not candidate"), "baseline_p95"), "event_type")
    allowed = F.greatest(1.3 * F.col("baseline_p95"), F.col("baseline_p95") + 30)
    return both.select("event_type", "candidate_p95", "baseline_p95", F.round(allowed, 6).alias("allowed"), (F.col("candidate_p95") <= allowed).alias("passed"))


@query("""
select event_type, count(*) as runs, cast(sum(coalesce(cast(props ->> '$.k' as bigint), 0)) as bigint) as tokens, round(avg(value), 6) as mean_value, max(event_id) as newest from events group by 1""")
def workflow_token_stats(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum(k).alias("tokens"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("event_id").alias("newest"))


@query("""
select count(*) as samples, count(*) filter (quality = 1) as passed, count(*) filter (toxic = 1) as blocked, round(count(*) filter (quality = 1) / count(*), 6) as pass_rate,
 max(n_chars) as most_chars, round(avg(n_chars), 6) as mean_chars from labels join documents using (doc_id)""")
def run_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return rows.agg(F.count(F.lit(1)).alias("samples"), good.alias("passed"), F.count_if(F.col("toxic") == 1).alias("blocked"), F.round(good / F.count(F.lit(1)), 6).alias("pass_rate"), F.max("n_chars").alias("most_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query(f"""
with i as (select d.doc_id, case when quality = 1 then ['global'] else [source, lang] end as scopes from documents d join labels using (doc_id) where toxic = 0), c as (select 'p' || n as pack, ['global', 'src' || n, case when n % 2 = 0 then 'fr' end] as scopes from range(6) t(n)),
m as (select distinct pack, doc_id from (select pack, unnest(scopes) as s from c) x join (select doc_id, unnest(scopes) as s from i) y using (s))
select pack, doc_id, row_number() over (partition by pack order by doc_id) as place from m qualify row_number() over (partition by pack order by doc_id) <= 8""")
def memory_scope_match(spark, d):
    """Approved items for each context: those with a scope in common, and global ones; the first eight."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 0"), "doc_id")
    items = docs.select("doc_id", F.when(F.col("quality") == 1, F.array(F.lit("global"))).otherwise(F.array("source", "lang")).alias("scopes"))
    contexts = spark.range(6).select(F.concat(F.lit("p"), "id").alias("pack"), F.array(F.concat(F.lit("src"), "id"), F.when(F.col("id") % 2 == 0, "fr")).alias("scopes"))
    return records.scoped_items(items, contexts, "doc_id", "pack", 8)


# extensions: not among the surveyed operators, but Spark has them


@query("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("select event_id, e.user_id, (select max(x.event_id) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and x.ts <= e.ts) as last_purchase from events e where event_type = 'error'")
def ext_asof(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return budgets.carried(rows, "user_id", "at", ["event_id"], bought, "last_purchase", same_rank=True).where("event_type = 'error'").select("event_id", "user_id", "last_purchase")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def ext_window_counts(spark, d):
    return fold.windowed_counts(table(spark, d, "events"))


from evidra.plans import catalog_evidence, catalog_more, catalog_packs, catalog_reports, catalog_runs, catalog_states, catalog_tables, catalog_text, catalog_versions  # noqa: E402, F401  more queries
