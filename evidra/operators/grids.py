"""Tables as rows of cells: header election, kinds of columns, width, profiles, and budgets of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import collapse_space
from evidra.operators.budgets import running_sums
from evidra.sources.staging import staged

# Words by which a header belongs to a kind of column, and words that make a column a key one.
KINDS: dict[str, tuple[str, ...]] = {
    "enterprise": ("enterprise", "company", "manufacturer", "supplier", "distributor", "企业", "申报企业", "生产企业", "配送企业"),
    "product": ("product", "item", "goods", "耗材", "产品", "通用名", "项目名称"),
    "registration_cert": ("registration", "certificate", "cert", "注册证", "备案号"),
    "medical_insurance_code": ("medical_insurance", "insurance_code", "医保编码", "医保耗材代码", "医保代码"),
    "price": ("price", "selected_price", "bid_price", "申报价", "报价", "中选价", "挂网价", "价格"),
    "purchase_volume": ("purchase_volume", "volume", "quantity", "采购量", "报量", "需求量", "约定采购量"),
    "selected_status": ("selected_status", "status", "selected", "winner", "中选", "拟中选", "入围", "状态"),
    "region": ("region", "province", "city", "area", "地区", "省", "市", "地市"),
    "group": ("group", "category", "分组", "分类", "组别"),
}
KEYS = (
    "企业名称", "申报企业", "生产企业", "配送企业", "产品名称", "通用名", "耗材名称", "项目名称", "项目编码", "服务项目", "注册证号", "备案号", "医保编码", "医保耗材代码", "医保代码", "医保支付", "支付类别", "支付标准",
    "规格型号", "申报价", "报价", "价格", "中选价", "挂网价", "收费", "采购量", "报量", "需求量", "约定采购量", "地区", "分组", "分类", "中选状态",
)
#: Rows in which a header is looked for; the most that filled cells count for it.
HEADER_ROWS, MOST_FILLED = 25, 12


def _any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def kinds_of(header: Column, kinds: Mapping[str, Sequence[str]] = KINDS) -> Column:
    """The kinds that a header belongs to, letters in either case."""
    low = F.lower(header)
    return F.filter(F.array(*[F.when(_any(low, [w.lower() for w in words]), F.lit(kind)) for kind, words in kinds.items()]), lambda x: x.isNotNull())


def header_score(cells: Column, keys: Sequence[str] = KEYS, kinds: Mapping[str, Sequence[str]] = KINDS) -> Column:
    """(score, keys, filled) of a row as a header: 10 for each key column, 4 for each kind of column that is there, and one for each
    filled cell up to 12. Structs compare field by field, so ties in the score go by keys, then by filled cells."""
    clean = F.transform(cells, lambda c: collapse_space(F.coalesce(c, F.lit(""))))
    n_keys = F.size(F.filter(clean, lambda c: _any(c, keys)))
    joined = F.lower(F.array_join(clean, " "))
    n_kinds = sum((F.when(_any(joined, [w.lower() for w in words]), 1).otherwise(0) for words in kinds.values()), F.lit(0))
    filled = F.size(F.filter(clean, lambda c: c != ""))
    return F.struct((10 * n_keys + 4 * n_kinds + F.least(filled, F.lit(MOST_FILLED))).alias("score"), n_keys.alias("keys"), filled.alias("filled"))


def headers(rows: DataFrame, group: str, row_no: str, cells: str, **options) -> DataFrame:
    """For each table (group) its header: the best row among the first 25, the earliest of equal ones. Combined within tasks."""
    first = rows.where(F.col(row_no) < HEADER_ROWS).withColumn("s", header_score(F.col(cells), **options))
    best = F.max_by(F.struct(row_no, cells, "s"), F.struct("s", -F.col(row_no))).alias("x")
    return first.groupBy(group).agg(best).select(group, F.col(f"x.{row_no}").alias("header_row"), F.col(f"x.{cells}").alias("header"), F.col("x.s.score").cast("long").alias("score"))


def fitted(cells: Column, width: int, mark: str = "；") -> Column:
    """Cells cleaned and brought to a width: short rows are padded, what is too much is joined into the last cell."""
    clean = F.transform(cells, lambda c: collapse_space(F.coalesce(c, F.lit(""))))
    padded = F.concat(clean, F.array_repeat(F.lit(""), width))
    rest = F.array(F.array_join(F.filter(F.slice(clean, width, 1_000_000), lambda c: c != ""), mark))
    return F.when(F.size(clean) <= width, F.slice(padded, 1, width)).otherwise(F.concat(F.slice(clean, 1, width - 1), rest))


def pooled_stats(values: DataFrame, kind: str, value: str, order: Sequence[str], samples: int = 5) -> DataFrame:
    """For each kind of column, over all columns of that kind together: filled cells, different values, the first different ones, and
    of their numbers the range. Values are first combined by value, so a hot one is one row for each task."""
    text = collapse_space(F.col(value))
    number = F.regexp_extract(F.replace(F.col("v"), F.lit(","), F.lit("")), "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")
    each = values.select(kind, text.alias("v"), F.struct(*order).alias("at")).where("v <> ''").groupBy(kind, "v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).withColumn("x", number)
    sample = each.withColumn("r", F.row_number().over(Window.partitionBy(kind).orderBy("at"))).where(F.col("r") <= samples).groupBy(kind)
    joined = sample.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda s: s.v), "|").alias("samples"))
    stats = each.groupBy(kind).agg(F.sum("n").alias("non_empty"), F.count(F.lit(1)).alias("unique_values"), F.min("x").alias("least"), F.max("x").alias("most"))
    return stats.join(joined, kind)


def spread_places(n: Column, k: Column) -> Column:
    """The places (from 0) of k of n things, evenly spread: round(i (n - 1) / (k - 1)), halves to even; the first one if k is 1."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int"))
    all_of_them = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(k <= 0, F.array().cast("array<int>")).when(n <= k, all_of_them).otherwise(some)


def cell_budget(cells: DataFrame, group: str, order: str, table: str, first: Column, limit: int, slots: int | None = None) -> DataFrame:
    """At most `limit` cells of each group: first the anchors (its first and last cell and the first of each table), then cells that
    `first` holds for, then the others; each evenly spread over its kind. All, where a group has no more than the limit. The number
    `order` is told once in a group.

    A later kind is taken from only if all of the kinds before it are taken, so the kind of a cell doesn't depend on what was taken:
    places in all three kinds come from one running count in slots of the order, and no task sees a whole group."""
    tables_ = staged(cells.groupBy(group, table).agg(F.min(order).alias("first_"), F.max(order).alias("last_"), F.count(F.lit(1)).alias("n_")), "tables")
    ends = tables_.groupBy(group).agg(F.min("first_").alias("lo_"), F.max("last_").alias("hi_"), F.sum("n_").alias("n_"))
    known = tables_.join(ends.withColumnRenamed("n_", "cells_"), group).select(group, F.col(table).alias("table_"), "first_", "lo_", "hi_", "cells_")
    told = cells.join(staged(known, "ends").withColumnRenamed(group, "group_"), (F.col(group) == F.col("group_")) & F.col(table).eqNullSafe(F.col("table_")))
    anchor = (F.col(order) == F.col("first_")) | (F.col(order) == F.col("lo_")) | (F.col(order) == F.col("hi_"))
    kinds = told.withColumn("kind_", F.when(anchor, 0).when(first, 1).otherwise(2)).withColumn("one_", F.lit(1).cast("long"))
    counts = kinds.groupBy(group).agg(*(F.count_if(F.col("kind_") == k).alias(f"m_{k}") for k in range(3)))
    placed = running_sums(kinds.select(*cells.columns, "kind_", "cells_", "one_"), [group, "kind_"], order, ["one_"], slots).join(staged(counts, "kinds"), group)
    m = F.element_at(F.array("m_0", "m_1", "m_2"), F.col("kind_") + 1).cast("int")
    before = F.when(F.col("kind_") == 0, F.lit(0)).when(F.col("kind_") == 1, F.col("m_0")).otherwise(F.col("m_0") + F.col("m_1"))
    take = F.least(m, F.greatest(F.lit(limit) - before, F.lit(0)).cast("int"))
    chosen = F.array_contains(spread_places(m, take), (F.col("so_far_one_") - 1).cast("int"))
    out = placed.withColumn("tier", F.when(chosen, F.col("kind_"))).where(F.col("tier").isNotNull() | (F.col("cells_") <= limit))
    return out.select(*cells.columns, "tier")


def unique_tables(cells: DataFrame, table: Sequence[str], row: str, column: str, value: str) -> DataFrame:
    """Tables (by their key columns) with the sha256 of their cells in order, and whether they are the first with these cells."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(row, column, collapse_space(F.coalesce(F.col(value), F.lit(""))).alias("v")))), lambda x: F.concat_ws("\x1f", x[row], x[column], x.v)), "\x1e")
    prints = cells.groupBy(*table).agg(F.sha2(said, 256).alias("fingerprint"))
    first = prints.groupBy("fingerprint").agg(F.min(F.struct(*table)).alias("of"), F.count(F.lit(1)).alias("copies"))
    return prints.join(first, "fingerprint").select(*table, "fingerprint", "copies", (F.struct(*table) == F.col("of")).alias("kept"))


def markdown_table(headers_col: Column, rows_col: Column) -> Column:
    """A pipe table of a header (array) and rows (array of arrays); pipes in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers_col, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers_col), rule), F.transform(rows_col, line)), "\n")


def table_profiles(cells: DataFrame, table: str, row: str, place: str, header: str, value: str, kinds: Mapping[str, Sequence[str]], numeric: Sequence[str], samples: int = 5) -> DataFrame:
    """(table, n_rows, n_columns, headers, profile): the summary of each table. profile has for every kind of column that the table has: its
    columns, filled cells, different values, the first different ones; and for numeric kinds the range of the numbers and the first ones.

    Kinds are told by the headers. Values are combined within tasks, and of samples only the first few of each task are shuffled."""
    clean = collapse_space(F.coalesce(F.col(value).cast("string"), F.lit("")))
    rows = cells.select(F.col(table).alias("t"), F.struct(F.col(row).alias("r"), F.col(place).alias("p")).alias("at"), F.col(header).alias("h"), clean.alias("v"))
    shape = rows.groupBy("t").agg(F.count_distinct("at.r").alias("n_rows"), F.count_distinct("at.p").alias("n_columns"), F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("at.p", "h"))), lambda x: x["h"])).alias("headers"))
    told = rows.where("v <> ''").select("*", F.explode(kinds_of(F.col("h"), kinds)).alias("kind"))
    number = F.regexp_extract(F.replace(F.col("v"), F.lit(","), F.lit("")), "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")
    x = F.when(F.col("kind").isin(*numeric), number)
    values = told.groupBy("t", "kind", "v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.min(x).alias("x"))
    stats = values.groupBy("t", "kind").agg(F.sum("n").alias("non_empty"), F.count(F.lit(1)).alias("different"), F.min("x").alias("least"), F.max("x").alias("most"))

    def first(rows: DataFrame, column: Column, name: str) -> DataFrame:
        place_ = F.row_number().over(Window.partitionBy("t", "kind").orderBy("at"))
        few = rows.select("t", "kind", "at", column.alias("c")).where("c is not null").withColumn("k", place_).where(F.col("k") <= samples)
        return few.groupBy("t", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias(name))

    both = stats.join(first(values, F.col("v"), "samples"), ["t", "kind"]).join(first(told, x, "numbers"), ["t", "kind"], "left")
    profile = F.sort_array(F.collect_list(F.struct("kind", "non_empty", "different", "samples", "least", "most", F.coalesce("numbers", F.array().cast("array<double>")).alias("numbers"))))
    return shape.join(both.groupBy("t").agg(profile.alias("profile")), "t", "left").withColumnRenamed("t", table)
