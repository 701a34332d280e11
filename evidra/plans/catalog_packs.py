"""Queries over packs: profiles of materials, the second pass, shares of a limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import scalars
from evidra.operators import packs
from evidra.plans.registry import query
from evidra.sources import table

# Documents as materials: a pack holds those of a source whose ids lie together, lines by fives are attachments, and the place of a line in its
# attachment tells its field. The first lines of a document are the material's own fields.
_SQL_FIELDS = """d as (select source || '/' || (doc_id // 200) as pack, doc_id, lang, case when lang = 'en' then 'primary' else 'auxiliary' end as role, regexp_split_to_array(text, '\\n') as a from documents),
m as (select *, row_number() over (partition by pack, role order by doc_id) - 1 as material from d),
l as (select pack, lang, role, material, unnest(a) as text, generate_subscripts(a, 1) - 1 as k from m),
f as (select pack, lang, role, material, case when k < 4 then -1 else (k - 4) // 5 end as attachment,
 case when k < 4 then ['summary', 'content_text', 'policy_rules', 'warnings'][k + 1] when (k - 4) % 5 = 0 then 'summary' when (k - 4) % 5 < 3 then 'key_facts' else 'sections' end as field,
 case when k < 4 or (k - 4) % 5 = 0 then 0 when (k - 4) % 5 < 3 then (k - 4) % 5 - 1 else (k - 4) % 5 - 3 end as i, text from l)"""


def _fields(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").withColumn("pack", F.concat("source", F.lit("/"), F.expr("doc_id div 200"))).withColumn("role", F.when(F.col("lang") == "en", "primary").otherwise("auxiliary"))
    numbered = docs.withColumn("material", F.row_number().over(Window.partitionBy("pack", "role").orderBy("doc_id")) - 1)  # 200 ids at most
    lines = numbered.select("pack", "lang", "role", "material", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    own, place = F.col("k") < 4, (F.col("k") - 4) % 5
    field = F.when(own, F.element_at(F.array(*map(F.lit, ("summary", "content_text", "policy_rules", "warnings"))), F.least("k", F.lit(3)) + 1)).when(place == 0, "summary").when(place < 3, "key_facts").otherwise("sections")
    i = F.when(own | (place == 0), 0).when(place < 3, place - 1).otherwise(place - 3)
    return lines.select("pack", "lang", "role", "material", F.when(own, -1).otherwise(F.floor((F.col("k") - 4) / 5)).cast("int").alias("attachment"), field.alias("field"), i.alias("i"), "text")


_STRATEGIES = ("safe_compact", "table_heavy", "light_compact", "full_input")
_SQL_CUT = "case when length(text) <= n then text else text[1:n * 65 // 100] || ' [...] ' || text[length(text) - (n - n * 65 // 100) + 1:] end"


@query(f"""
with {_SQL_FIELDS}, s as (select *, ['safe_compact', 'table_heavy', 'light_compact', 'full_input'][cast(split_part(pack, '/', 2) as int) % 4 + 1] as strategy from f where material < case role when 'primary' then 3 else 10 end),
x as (select *, strategy = 'full_input' as whole,
 case when attachment < 0 then case field when 'summary' then 1 when 'content_text' then 1 when 'policy_rules' then case role when 'primary' then 6 end else 6 end else case field when 'summary' then 1 when 'key_facts' then 16 else 8 end end as items,
 case when attachment < 0 then case field when 'summary' then 500 when 'warnings' then 220 when 'policy_rules' then case role when 'primary' then 300 end
  else case when role = 'primary' then case strategy when 'safe_compact' then 12000 when 'table_heavy' then 9000 else 5200 end else case strategy when 'safe_compact' then 600 when 'table_heavy' then 700 else 900 end end end
  else case field when 'summary' then 500 when 'key_facts' then 180 else 300 end end as n from s),
k as (select * exclude (text), case when whole or n is null then text else {_SQL_CUT} end as text from x
 where whole or ((items is null or i < items) and attachment < case when role = 'primary' then 8 when strategy in ('safe_compact', 'table_heavy') then 2 else 4 end)),
g as (select pack, role, material, attachment, field, string_agg(text, chr(31) order by i) as t, count(*) as n, sum(length(text)) as chars from k group by 1, 2, 3, 4, 5),
h as (select pack, role, material, attachment, string_agg(field || ':' || t, chr(30) order by field) as t, sum(n) as n, sum(chars) as chars from g group by 1, 2, 3, 4),
o as (select pack, role, material, string_agg(attachment || '=' || t, chr(29) order by attachment) as t, sum(n) as n, sum(chars) as chars from h group by 1, 2, 3)
select pack, count(*) as materials, cast(sum(n) as bigint) as texts, cast(sum(chars) as bigint) as chars, sha256(string_agg(role || material || chr(28) || t, chr(27) order by role desc, material)) as digest from o group by 1""")
def material_profiles(spark, d):
    """The first materials of each pack, cut by role and strategy, folded into one nested value for each pack."""
    rows = _fields(spark, d)
    number = F.split("pack", "/")[1].cast("int") % 4
    strategies = rows.select("pack").distinct().withColumn("strategy", F.element_at(F.array(*map(F.lit, _STRATEGIES)), number + 1))
    nested = packs.folded(packs.material_profiles(rows.drop("lang"), strategies))
    told = lambda fields: F.array_join(F.transform(fields, lambda f: F.concat(f["field"], F.lit(":"), F.array_join(f["texts"], "\x1f"))), "\x1e")
    files = lambda m: F.transform(m["attachments"], lambda a: F.concat(a["attachment"].cast("string"), F.lit("="), told(a["fields"])))
    own = lambda m: F.when(m["fields"].isNotNull(), F.array(F.concat(F.lit("-1="), told(m["fields"])))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.transform("materials", lambda m: F.concat(m["role"], m["material"].cast("string"), F.lit("\x1c"), F.array_join(F.concat(own(m), files(m)), "\x1d"))), "\x1b")
    texts = F.flatten(F.transform("materials", lambda m: F.concat(F.flatten(F.transform(F.coalesce(m["fields"], F.expr("array()")), lambda f: f["texts"])), F.flatten(F.transform(m["attachments"], lambda a: F.flatten(F.transform(a["fields"], lambda f: f["texts"])))))))
    chars = F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    return nested.select("pack", F.size("materials").cast("long").alias("materials"), F.size(texts).cast("long").alias("texts"), chars.alias("chars"), F.sha2(whole, 256).alias("digest"))


#: Limit of a pack in these queries; the operator's own is that of the tiers.
LIMIT = 24_000
_SQL_PACKS = f"""t as (select pack, cast(sum(length(text)) as bigint) as total from f group by 1),
w as (select pack, total, case when total <= {LIMIT + 10_000} then 'light' when total <= 150000 then 'medium' else 'strong' end as tier, {LIMIT} - case when total <= {LIMIT + 10_000} then 500 else 1000 end as ceiling,
 {LIMIT} - case when total <= {LIMIT + 10_000} then 2000 when total <= 150000 then 10000 else 5000 end as floor from t where total > {LIMIT}),
p as (select *, greatest(floor, ceiling - {packs.ROOM}) as target from w)"""


def _over(rows):
    """(pack, tier, total, ceiling, target) of the packs above the limit."""
    totals = rows.groupBy("pack").agg(F.sum(F.length("text")).cast("long").alias("total")).where(F.col("total") > LIMIT)
    window = scalars.tier_window(F.col("total"), LIMIT)
    return totals.select("pack", scalars.compression_tier(F.col("total"), LIMIT).alias("tier"), "total", window.ceiling.alias("ceiling"), F.greatest(window.floor, window.ceiling - packs.ROOM).alias("target"))


@query(f"""
with {_SQL_FIELDS}, {_SQL_PACKS}, x as (select f.*, total, target, case tier when 'light' then 1000 when 'medium' then 900 else 700 end as lowest, total - target as excess, length(text) as n from f join p using (pack)),
r as (select *, case when field = 'summary' then greatest(n - lowest, 0) else 0 end as room from x), y as (select *, sum(room) over (partition by pack order by n desc, material, role, attachment, field, i rows unbounded preceding) as running from r)
select pack, total, target, cast(sum(n - least(room, greatest(excess - (running - room), 0))) as bigint) as chars, sum(n - least(room, greatest(excess - (running - room), 0))) <= target as fits, count(*) filter (room > 0 and excess > running - room) as cut_texts from y group by 1, 2, 3""")
def second_pass_trim(spark, d):
    """The second pass begins: summaries of packs above the limit are cut, the longest first, none below the least of the tier."""
    rows = _fields(spark, d).drop("lang")
    over = _over(rows)
    told = packs.trimmed_summaries(rows, over, F.col("field") == "summary").join(over.select("pack", "total", "target"), "pack")
    cut = F.count_if(F.col("chars") < F.length("text"))
    out = told.groupBy("pack", "total", "target").agg(F.sum("chars").alias("chars"), cut.alias("cut_texts"))
    return out.select("pack", "total", "target", "chars", (F.col("chars") <= F.col("target")).alias("fits"), "cut_texts")


_SQL_RUNGS = ", ".join(str((t, k + 1, *p)) for t, names in packs.LADDERS for k, n in enumerate(names) for p in packs.PROFILES if p[0] == n)


@query(f"""
with {_SQL_FIELDS}, {_SQL_PACKS}, v as (select * from (values {_SQL_RUNGS}) v(tier, step, profile, lowest, facts, fact_chars, secs, sec_chars)), q as (select * from p join v using (tier)),
x as (select pack, step, field, length(text) as n, q.* exclude (pack, step) from f join q using (pack) where attachment < 8 and not (field = 'key_facts' and i >= facts) and not (field = 'sections' and i >= secs)),
o as (select pack, step, cast(coalesce(sum(case field when 'key_facts' then least(n, fact_chars) when 'sections' then least(n, sec_chars) else n end) filter (field <> 'summary'), 0) as bigint) as rest from x group by 1, 2),
s as (select pack, step, n, least(n, lowest) as low from x where field = 'summary'), c as (select distinct pack, step, turn from (select pack, step, n as turn from s union all select pack, step, low from s)),
e as (select c.pack, c.step, c.turn, sum(least(n, greatest(low, turn))) as taken, count(*) filter (low <= turn and n > turn) as slope from c join s on s.pack = c.pack and s.step = c.step group by 1, 2, 3),
b as (select pack, step, arg_max({{'turn': turn, 'taken': taken, 'slope': slope}}, turn) as z from e join o using (pack, step) join q using (pack, step) where taken <= target - rest group by 1, 2),
u as (select pack, step, profile, target, rest, greatest(z.turn + case when z.slope > 0 then (target - rest - z.taken) // z.slope else 0 end, lowest) as summary_limit from b join o using (pack, step) join q using (pack, step)),
k as (select u.pack, u.step, u.profile, u.summary_limit, u.rest + sum(least(n, u.summary_limit)) as chars from u join s on s.pack = u.pack and s.step = u.step group by 1, 2, 3, 4, u.rest)
select p.pack, step, profile, cast(summary_limit as bigint) as summary_limit, cast(chars as bigint) as chars from p left join (select * from k qualify row_number() over (partition by pack order by step) = 1) k using (pack)""")
def profile_ladder(spark, d):
    """The second pass goes on: the first profile of the ladder under which a pack fits, with the largest limit of its summaries."""
    rows = _fields(spark, d).drop("lang")
    return packs.profile_ladder(rows, _over(rows).select("pack", "tier", "target"))


_SQL_LEVELS = """
 c{n} as (select distinct {keys}, turn from (select {keys}, size as turn from n{n} union all select {keys}, low from n{n})),
 e{n} as (select {ckeys}, turn, sum(least(size, greatest(low, turn))) as taken, count(*) filter (low <= turn and size > turn) as slope from c{n} c join n{n} s on {on} group by {ckeys}, turn),
 b{n} as (select {keys}, arg_max({{'turn': turn, 'taken': taken, 'slope': slope}}, turn) as z, any_value(budget) as budget from e{n} join g{n} using ({keys}) where taken <= budget group by {keys}),
 v{n} as (select {keys}, z.turn + case when z.slope > 0 then (budget - z.taken) // z.slope else 0 end as level from b{n})"""


def _sql_level(n: int, keys: tuple[str, ...]) -> str:
    return _SQL_LEVELS.format(n=n, keys=", ".join(keys), ckeys=", ".join(f"c.{k}" for k in keys), on=" and ".join(f"c.{k} = s.{k}" for k in keys))


@query(f"""
with {_SQL_FIELDS}, {_SQL_PACKS}, s as (select pack, role || material as material, attachment, field, i, text, length(text) as size, case when regexp_matches(text, '[0-9]{{3,}}') then length(text) else least(length(text), 12) end as low, ceiling from f join p using (pack)),
 n1 as (select pack, material, sum(size) as size, sum(low) as low from s group by 1, 2), g1 as (select pack, ceiling as budget from p), {_sql_level(1, ('pack',))},
 g2 as (select pack, material, least(size, greatest(low, coalesce(level, 0))) as budget from n1 left join v1 using (pack)), n2 as (select pack, material, attachment, sum(size) as size, sum(low) as low from s group by 1, 2, 3), {_sql_level(2, ('pack', 'material'))},
 g3 as (select pack, material, attachment, least(size, greatest(low, coalesce(level, 0))) as budget from n2 left join v2 using (pack, material)), n3 as (select * from s), {_sql_level(3, ('pack', 'material', 'attachment'))},
 r as (select s.*, least(size, greatest(low, coalesce(level, 0))) as kept from s left join v3 using (pack, material, attachment)),
 x as (select *, greatest(kept - 7, 0) as m from r), y as (select *, case when size <= kept then text else (text[1:m * 65 // 100] || ' [...] ' || case when m > m * 65 // 100 then text[length(text) - (m - m * 65 // 100) + 1:] else '' end)[1:kept] end as t from x)
select pack, cast(y.ceiling as bigint) as ceiling, cast(sum(length(t)) as bigint) as chars, sum(length(t)) <= y.ceiling as fits, sum(low) > y.ceiling as over_limit, count(*) filter (low = size) as protected_texts, count(*) filter (low = size and t = text) as protected_whole,
 sha256(string_agg(t, chr(30) order by material, attachment, field, i)) as digest from y group by pack, y.ceiling""")
def hard_limit_pack(spark, d):
    """The second pass ends: what a pack above its limit may hold is shared out over its materials, their attachments and their texts;
    texts with a number and very short ones stay whole."""
    rows = _fields(spark, d).withColumn("material", F.concat("role", F.col("material").cast("string")))
    ceilings = _over(rows).select("pack", F.col("ceiling").alias("budget"))
    own = rows.join(ceilings.select("pack"), "pack", "left_semi").select("pack", "material", "attachment", "field", "i", "text", F.length("text").alias("before"), F.regexp_like("text", F.lit("[0-9]{3,}")).alias("fact"))
    out = packs.hard_limit(own, F.col("fact"), 12, ceilings).join(ceilings, "pack")
    safe = F.col("fact") | (F.col("before") <= 12)
    told = out.groupBy("pack", F.col("budget").alias("ceiling")).agg(
        F.sum(F.length("text")).cast("long").alias("chars"), F.max("over").alias("over_limit"), F.count_if(safe).alias("protected_texts"), F.count_if(safe & F.col("whole")).alias("protected_whole"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("material", "attachment", "field", "i", "text"))), lambda x: x["text"]), "\x1e"), 256).alias("digest"),
    )
    return told.select("pack", "ceiling", "chars", (F.col("chars") <= F.col("ceiling")).alias("fits"), "over_limit", "protected_texts", "protected_whole", "digest")
