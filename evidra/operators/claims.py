"""Claims and the evidence for them: markers, candidates by shared anchors and terms, scores, support."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import claim_text, fold_width, hits
from evidra.operators.containment import TextIndex, held, text_index

#: Scores.
CONTAINED, REVERSE, REVERSE_CHARS = 100, 95, 500
MARKED_FROM, MARKED_MOST, PLAIN_FROM, PLAIN_MOST, PLAIN_EACH, PLAIN_TERMS, LONG_TERM = 80, 10, 60, 20, 3, 2, 4
# Dates, amounts with units, regions and offices that evidence must have.
DATE = r"20\d{2}(?:年|[-/.])\d{1,2}(?:月|[-/.])\d{1,2}日?"
VALUE = r"(?<!\d)\d+(?:,\d{3})*(?:\.\d+)?(?:万元|元(?:/[^，。；;|]+)?|%|％|年|个月|月|个工作日|工作日|日|天|个|件|家|份|批|轮)(?!\d)"
REGIONS = (
    "北京市", "天津市", "上海市", "重庆市", "河北省", "山西省", "辽宁省", "吉林省", "黑龙江省", "江苏省", "浙江省", "安徽省", "福建省", "江西省", "山东省", "河南省", "湖北省", "湖南省", "广东省", "海南省", "四川省",
    "贵州省", "云南省", "陕西省", "甘肃省", "青海省", "台湾省", "内蒙古自治区", "广西壮族自治区", "西藏自治区", "宁夏回族自治区", "新疆维吾尔自治区", "香港特别行政区", "澳门特别行政区",
)
OFFICES = (
    "国家医疗保障局", "医疗保障局", "医保局", "公共资源交易中心", "医药集中采购平台", "采购中心", "交易中心",
)
HINTS = (
    "采购", "申报", "报价", "价格", "中选", "执行", "协议", "周期", "范围", "企业", "医疗机构", "风险", "建议", "应", "须", "明确", "为",
)
#: Terms that claim and evidence may share: hints of two characters or more; labels of topics come in addition.
TERMS = tuple(h for h in HINTS if len(h) >= 2)


def hard_markers(c: Column) -> Column:
    """Dates, amounts, regions and offices that a text names; evidence for it must have them all."""
    wide = fold_width(c)
    found = [F.transform(F.regexp_extract_all(wide, F.lit(p), F.lit(0)), lambda m: claim_text(m)) for p in (DATE, VALUE)]
    places = hits(wide, REGIONS)
    both = F.flatten(F.transform(places, lambda p: F.transform(F.array(*map(F.lit, OFFICES)), lambda o: F.concat(p, o))))
    named = F.concat(places, F.filter(both, lambda x: F.contains(wide, x)), hits(wide, OFFICES))
    return F.array_distinct(F.filter(F.concat(*found, named), lambda m: m != ""))


def claim_like(c: Column) -> Column:
    """Whether a sentence states something: it has a marker, nine characters or more, or a word that claims are made with."""
    compact = claim_text(c)
    return (F.length(compact) >= 2) & ((F.length(compact) >= 9) | (F.size(hits(compact, HINTS)) > 0) | (F.size(hard_markers(compact)) > 0))


def contained(claims: DataFrame, evidence: DataFrame | TextIndex) -> DataFrame:
    """(claim, evidence) where the claim's text occurs in the evidence: claims (claim, text), evidence (evidence, text) or its index.
    Blank claims occur nowhere."""
    return held(claims, evidence if isinstance(evidence, TextIndex) else text_index(evidence))


def marked(claims: DataFrame, evidence: DataFrame | TextIndex) -> DataFrame:
    """(claim, evidence) where the evidence has all the markers of a claim that has some: claims (claim, markers)."""
    named = claims.where(F.size("markers") > 0).select("claim", F.size("markers").alias("needed"), F.explode("markers").alias("marker"))
    different = named.select(F.col("marker").alias("claim"), F.col("marker").alias("text")).distinct()
    found = contained(different, evidence).withColumnRenamed("claim", "marker")
    return named.join(found, "marker").groupBy("claim", "evidence", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed").select("claim", "evidence")


def best_by_terms(claims: DataFrame, evidence: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(claim, evidence, score) for claims without markers: the evidence that shares most terms, 60 and 3 for each of them, 80 at
    most, if there are two or one of four characters. Evidence is grouped by the set of terms it has, claims are compared with
    these few sets, and only the best ones are brought back to the rows."""
    has = lambda rows, key: rows.select(key, hits(F.col("text"), terms).alias("terms")).where(F.size("terms") > 0)
    left, right = has(claims, "claim"), has(evidence, "evidence")
    said, sets = left.select(F.col("terms").alias("said")).distinct(), right.select("terms").distinct()
    by_term = said.select("said", F.explode("said").alias("term")).join(sets.select("terms", F.explode("terms").alias("term")), "term")
    both = by_term.groupBy("said", "terms").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("term")).alias("longest"))
    enough = both.where((F.col("n") >= PLAIN_TERMS) | (F.col("longest") >= LONG_TERM))
    scored = enough.withColumn("score", (PLAIN_FROM + F.least(F.lit(PLAIN_MOST), PLAIN_EACH * F.col("n"))).cast("long"))
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy("said"))).where("score = best").select("said", "terms", "score")
    return left.withColumnRenamed("terms", "said").join(top, "said").join(right, "terms").select("claim", "evidence", "score")


def claim_index(
    claims: DataFrame, evidence: DataFrame, claim_id: str, evidence_id: str, text: str = "text", terms: Sequence[str] = TERMS, normalise: Callable[[Column], Column] = claim_text, markers: Callable[[Column], Column] = hard_markers
) -> DataFrame:
    """(claim, evidence, score): 100 where the claim is contained, 95 where evidence up to 500 characters is contained in the claim.
    Else 0 if a marker of the claim isn't in the evidence; for a claim with markers 80 and one for each shared term, 90 at most,
    from one term on; without markers 60 and three for each, 80 at most, from two terms or one of four characters on. Of a claim's
    rows those with its best score stay, and all from 90 on."""
    left = claims.select(F.col(claim_id).alias("claim"), normalise(F.col(text)).alias("text"), markers(F.col(text)).alias("markers")).where(F.trim("text") != "")
    right = evidence.select(F.col(evidence_id).alias("evidence"), normalise(F.col(text)).alias("text")).where(F.trim("text") != "")
    index = text_index(right)
    right = index.texts
    full = contained(left.select("claim", "text"), index).withColumn("score", F.lit(CONTAINED).cast("long"))
    brief = right.where(F.length("text") <= REVERSE_CHARS).select(F.col("evidence").alias("claim"), "text")
    back = contained(brief, left.select(F.col("claim").alias("evidence"), "text")).select(F.col("evidence").alias("claim"), F.col("claim").alias("evidence"), F.lit(REVERSE).cast("long").alias("score"))
    found = full.unionByName(back)
    strict = marked(left, index).join(left.select("claim", hits(F.col("text"), terms).alias("said")), "claim").join(right.select("evidence", hits(F.col("text"), terms).alias("has")), "evidence")
    strict = strict.withColumn("n", F.size(F.array_intersect("said", "has"))).where("n > 0").select("claim", "evidence", (MARKED_FROM + F.least(F.lit(MARKED_MOST), F.col("n"))).cast("long").alias("score"))
    # at most 80: told only for claims that have nothing better
    plain = left.where(F.size("markers") == 0).join(found.select("claim").distinct(), "claim", "left_anti")
    part = best_by_terms(plain, right, terms)
    scored = found.unionByName(strict).unionByName(part).groupBy("claim", "evidence").agg(F.max("score").alias("score"))
    best = scored.groupBy("claim").agg(F.max("score").alias("best"))
    return scored.join(best, "claim").where((F.col("score") == F.col("best")) | (F.col("score") >= 90)).drop("best")


def support(claims: DataFrame, index: DataFrame, claim_id: str) -> DataFrame:
    """One row: claims, supported ones, links, and the support rate, which is 1 without claims."""
    per = index.groupBy("claim").agg(F.count(F.lit(1)).alias("links"), F.max("score").alias("score"))
    both = claims.select(F.col(claim_id).alias("claim")).join(per, "claim", "left")
    n, yes = F.count(F.lit(1)), F.count("links")
    return both.agg(n.alias("claims"), yes.alias("supported"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.round(yes / F.when(n > 0, n), 6), F.lit(1.0)).alias("support_rate"))
