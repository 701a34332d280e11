"""Facts of a domain: sentences that name a topic, their identity, and conflicts between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import normal_duration
from evidra.functions.text import collapse_space, fold_width, hits


@dataclass(frozen=True)
class Rules:
    """topics: (type, labels) in order; forbidden: phrases whose sentences say nothing; scalar: types that have one value for each
    record; durations: types whose value is a duration; required: types that a report must cover where there is evidence; sections: (id, words of its
    heading) of the sections that a report needs."""

    topics: tuple[tuple[str, tuple[str, ...]], ...]
    forbidden: tuple[str, ...] = ()
    scalar: tuple[str, ...] = ()
    durations: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    sections: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def __post_init__(self):
        types = [t for t, _ in self.topics]
        if len(set(types)) != len(types) or not all(types):
            raise ValueError("topics need different names")
        if any(not words or not all(w.strip() for w in words) for _, words in self.topics):
            raise ValueError("a topic needs labels that aren't blank")
        unknown = {*self.scalar, *self.durations, *self.required} - set(types)
        if unknown - {"region", "institution", "publication_date"}:
            raise ValueError(f"rules name unknown topics: {sorted(unknown)}")


#: The topics of procurement notices.
PROCUREMENT = Rules(
    topics=(
        ("procurement_varieties", ("采购品种", "采购范围", "产品范围")), ("procurement_cycle", ("采购周期", "采购期限", "协议期")), ("alliance_provinces", ("联盟省份", "联盟地区", "参与省份")),
        ("group_price_table", ("分组", "分组规则", "最高有效申报价", "报价上限")), ("quote_rules", ("报价要求", "报价规则", "申报价", "挂网价", "最低中选价")),
        ("selection_rules", ("拟中选规则", "中选规则", "中选资格")), ("agreed_purchase_volume", ("约定采购量", "采购需求量", "待分配量")),
    ),
    forbidden=("具体见采购文件", "具体数值见采购文件", "按采购文件执行", "详见采购文件", "以采购文件为准", "资料未显示", "需人工核验", "证据不足"),
    scalar=("procurement_cycle", "region", "institution", "publication_date"), durations=("procurement_cycle",),
    required=("procurement_varieties", "procurement_cycle", "alliance_provinces", "group_price_table", "quote_rules", "selection_rules", "agreed_purchase_volume"),
    sections=(
        ("overview", ("公告要点", "项目概况", "导语", "核心结论")), ("core_rules", ("核心规则", "采购品种", "产品范围", "报价要求", "价格机制")), ("actions", ("时间节点", "操作步骤", "申报操作", "执行安排")),
        ("impact_and_risk", ("企业影响", "风险提示", "执行关注")), ("recommendations", ("企业操作建议", "操作建议", "企业建议")),
    ),
)


def clean(c: Column) -> Column:
    return F.trim(collapse_space(fold_width(c)), F.lit("。；; "))


def candidates(records: DataFrame, record: str, item: str, text: str, rules: Rules) -> DataFrame:
    """(record, item, fact_type, label, value, normal): each sentence under each label that it names, but those with a forbidden phrase.
    Durations are normalised; one that has none is no candidate."""
    sentences = records.select(F.col(record).alias("record"), F.col(item).alias("item"), F.explode(F.regexp_extract_all(text, F.lit("[^。！？!?；;.\\n]+"), F.lit(0))).alias("raw"))
    said = sentences.withColumn("v", clean(F.col("raw"))).where("v <> ''")
    if rules.forbidden:
        said = said.where(F.size(hits(F.col("v"), rules.forbidden)) == 0)
    labels = F.array(*[F.struct(F.lit(t).alias("fact_type"), F.lit(w).alias("label")) for t, words in rules.topics for w in words])
    named = said.select("record", "item", "v", F.explode(F.filter(labels, lambda x: F.contains(F.col("v"), x.label))).alias("x")).select("record", "item", "x.fact_type", "x.label", F.col("v").alias("value"))
    normal = F.when(F.col("fact_type").isin(*rules.durations), normal_duration(F.col("value"))).otherwise(F.col("value")) if rules.durations else F.col("value")
    return named.withColumn("normal", normal).where("normal is not null")


def table_rows(cells: DataFrame, record: str, row: list[str], column: str, value: str) -> DataFrame:
    """(record, item, text): the cells of each row in the order of their columns, as one text, to find facts in; item tells the row."""
    said = F.transform(F.sort_array(F.collect_list(F.struct(column, F.trim(F.col(value)).alias("v")))), lambda x: x.v)
    joined = F.array_join(F.filter(said, lambda v: v != ""), " | ")
    return cells.groupBy(record, *row).agg(joined.alias("text")).select(record, F.concat_ws(":", *row).alias("item"), "text")


def topic_facts(records: DataFrame, record: str, item: str, text: str, rules: Rules) -> DataFrame:
    """(fact_key, fact_type, record, candidates, distinct_values, conflict, item, value): a fact of a scalar type is known by its record
    and type, any other by its value, too. Candidates that differ in a scalar's value are a conflict, and none of them stays; else the
    least by item, label and value."""
    found = candidates(records, record, item, text, rules)
    own = F.concat_ws(":", "record", "fact_type")
    key = F.when(F.col("fact_type").isin(*rules.scalar), own).otherwise(F.concat_ws(":", own, F.sha2("normal", 256))) if rules.scalar else F.concat_ws(":", own, F.sha2("normal", 256))
    grouped = found.withColumn("fact_key", key).groupBy("fact_key", "fact_type", "record").agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("normal").alias("distinct_values"), F.min(F.struct("item", "label", "value", "normal")).alias("best")
    )
    agree = F.col("distinct_values") == 1
    return grouped.select(
        "fact_key", "fact_type", F.col("record").alias(record), "candidates", "distinct_values", (~agree).alias("conflict"), F.when(agree, F.col("best.item")).alias(item), F.when(agree, F.col("best.value")).alias("value")
    )


def cross_supported(full: DataFrame, compact: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, level, state) of a full outer join of two evidence tables by id: supported where all fields agree (null equals null),
    changed where one differs, lost or added where one side lacks it."""
    a = full.select(key, F.struct(*fields).alias("a"))
    b = compact.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    state = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "supported").otherwise("changed")
    return both.select(key, F.coalesce("a", "b").alias("x"), state.alias("state")).select(key, "x.*", "state")


def relation(auxiliary: DataFrame, keywords: list[str], title: str, content: str) -> tuple[Column, Column, Column]:
    """(matched, score, relation): how many of a primary record's keywords an auxiliary one holds, the share of ten of them (1 at most),
    and what it is by its title."""
    matched = F.size(hits(F.concat_ws(" ", title, content), keywords))
    score = F.round(F.least(F.lit(1.0), matched / max(min(len(keywords), 10), 1)), 3)
    return matched.cast("long"), score, F.when(score < 0.15, "low").otherwise("related")
