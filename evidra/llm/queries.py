"""The queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidra.llm import byte_bpe, decontaminate, exact_dedup, filter_audit, fingerprints, lm_scoring, merkle, ngram_join, packing, quality, secrets, token_counts, toxicity
from evidra.llm.common import benchmark, documents, labels


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_quality(docs, quality.fit_quality(docs, labels(spark, sf_dir)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels(spark, sf_dir)))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = [op1_ngram_join, op2_lm_scoring, op3_quality, op4_byte_bpe, op5_packing, op6_token_counts, op7_exact_dedup, op8_fingerprints, op9_secrets, op10_toxicity, op11_decontamination, op12_filter_audit, op13_merkle_manifest, pipeline]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_ngram_join": f"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as a from documents
), g as (
  select doc_id, list_distinct(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')]
    else list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')) end) as s from w
), t as (select doc_id, unnest(s) as s from g),
n as (select doc_id, len(s) as n from g),
o as (select x.doc_id as a, y.doc_id as b, count(*) as shared from t x join t y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from o join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * shared >= 80 * (na.n + nb.n - shared)),
e as (select a, b from l union all select b, a from l),
r(a, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.a)
select n.doc_id, n.n as n_shingles, min(r.root) as component_id from n join r on r.a = n.doc_id group by 1, 2""",
    "op7_exact_dedup": f"""
with t as (select doc_id, {_LOWER} as s from documents)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
 row_number() over (partition by s order by doc_id desc nulls last) = 1 as kept, sha256(s) as text_sha256 from t""",
    "op11_decontamination": f"""
with w as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as a from benchmark),
g as (select coalesce(item_id::varchar, '') as item, least(len(a), 10) as n, unnest(list_transform(range(1, greatest(len(a) - 9, 1) + 1), lambda i: array_to_string(a[i:i + 9], ' '))) as s from w where len(a) > 0),
d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as a from documents),
t as (select r, a, n, unnest(range(1, len(a) - n + 2)) as i from d, (select distinct n from g) where len(a) >= n),
o as (select r, i, t.n, item from (select r, i, n, array_to_string(a[i:i + n - 1], ' ') as s from t) t join g on g.n = t.n and g.s = t.s),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from o)) group by 1),
m as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from o) group by 1)
select doc_id, len(a)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (r) left join m using (r)""",
    "op12_filter_audit": """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as a, min(doc_id) over (partition by t) as least from d),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) = 1 as good, coalesce(max((toxic = 1)::int), 0) = 1 as toxic from labels group by 1),
f as (select part, concat(case when len(a) < 200 then 'A' end, case when 100 * len(list_distinct(a)) < 50 * len(a) then 'B' end,
    case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) then 'C' end, case when regexp_matches(t, '[#$%&*|]') then 'D' end,
    case when least < w.doc_id then 'E' end) as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l using (doc_id)),
s as (select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select p.x || q.x || r.x || u.x || v.x as filter_order from x p, x q, x r, x u, x v where len(list_distinct([p.x, q.x, r.x, u.x, v.x])) = 5),
g as (select filter_order, step, filter_order[step:step] as filter, filter_order[1:step - 1] as prior from o, (select unnest(range(1, 6))::int as step)),
c as (select s.*, g.*, length(translate(prior, fails, '')) = step - 1 as there, contains(fails, filter) as failing from s, g),
r as (select part, filter_order, step, filter, coalesce(sum(n) filter (there and not failing), 0)::bigint as kept, coalesce(sum(n) filter (there and failing), 0)::bigint as removed,
    coalesce(sum(n) filter (failing and not there), 0)::bigint as redundant, coalesce(sum(n) filter (fails = filter), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (there and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (there and failing), 0)::bigint as toxic_lost from c group by 1, 2, 3, 4)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from r""",
    "op13_merkle_manifest": """
with recursive d as (select *, case when list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) is null then null
  else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) end as crc from documents),
f as (select doc_id, lang, coalesce(crc % 7 = 0, false) as hit, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail, n_chars, n_chars + 1 as more from d),
l as (select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen((case when hit then more else n_chars end)::varchar) || ':' || (case when hit then more else n_chars end), '-') || tail) as changed from f),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
t as (select lang, n, 0 as level, i, leaf as h from p
  union all select lang, (n + 1) // 2, level + 1, i // 2, sha256(h || coalesce(h2, '')) from (select *, lead(h) over (partition by lang order by i) as h2 from t) where n > 1 and i % 2 = 0),
g as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t where n = 1),
r as (select n, 0 as level, i, subroot as h from g
  union all select (n + 1) // 2, level + 1, i // 2, sha256(h || coalesce(h2, '')) from (select *, lead(h) over (order by i) as h2 from r) where n > 1 and i % 2 = 0),
w as (select doc_id, leaf, lang, 0 as level, i, n, changed as own, '' as proof from p
  union all select doc_id, leaf, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2, sha256(case when w.i % 2 = 0 then own || coalesce(h, '') else coalesce(h, '') || own end), proof || coalesce(h, '')
  from w left join t on t.lang is not distinct from w.lang and t.level = w.level and t.i = xor(w.i, 1) where w.n > 1),
u as (select doc_id, leaf, subroot, 0 as level, g.i, g.n, own, proof from w join g on g.lang is not distinct from w.lang where w.n = 1
  union all select doc_id, leaf, subroot, u.level + 1, u.i // 2, (u.n + 1) // 2, sha256(case when u.i % 2 = 0 then own || coalesce(h, '') else coalesce(h, '') || own end), proof || coalesce(h, '')
  from u left join r on r.level = u.level and r.i = xor(u.i, 1) where u.n > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, own as folded_root, own = root as verified from u, (select h as root from r where n = 1) where n = 1""",
}
