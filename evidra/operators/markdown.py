"""Markdown reports as lines: what each line is, the claims it makes, the parts of the report, and their checks.

Lines are rows (id, line_no, line); what depends on the lines before and after comes from windows over one report. Reports are dealt
once, whole, over as many partitions as their texts need; all windows are in one order, so that a task sorts its lines once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import claim_text, collapse_space, fold_width, hits, inline_text
from evidra.operators.claims import claim_like

SENTENCE_ENDS = "。！？!?；;"
#: Version that goes into the identity of a claim.
CLAIM_VERSION = "claim-1"
#: Characters of reports in a partition, about; their lines take some tens of times as many bytes while they are sorted.
PARTITION_CHARS = 4 << 20
_PREFIX = "^(?:[-*+>]\\s+|\\d+[.)、]\\s*)+"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^\\|+|\\|+$", ""), "\\|"), lambda c: F.trim(c))


def _is_rule(line: Column) -> Column:
    """A row of dashes and colons, under a header."""
    return line.startswith("|") & F.forall(_cells(line), lambda c: c.rlike("^[-: ]+$"))


def _dealt(reports: DataFrame, key: str, markdown: str) -> DataFrame:
    """Reports by key in partitions of a bounded size (counts characters first); the session's number of partitions at least."""
    chars = reports.agg(F.sum(F.length(markdown))).first()[0] or 0
    least = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reports.repartition(max(least, -(-chars // PARTITION_CHARS)), key)


def lines(reports: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, line_no, line, kind, table_no, row_no, header, section_no): line_no from 0; kind is fence, code, blank, heading, header, rule,
    row or text. header: the cells of the table's header, for rows; section_no counts the headings so far."""
    rows = _dealt(reports.select(key, markdown), key, markdown).select(key, F.posexplode(F.split(F.coalesce(F.col(markdown), F.lit("")), "\r?\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).drop("raw")
    of = Window.partitionBy(key).orderBy("line_no")
    so_far = of.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```")
    rows = rows.withColumn("fences", F.count_if(fence).over(so_far)).withColumn("next", F.lead("line").over(of))
    line, bar = F.col("line"), F.col("line").startswith("|")
    kind = (
        F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(line == "", "blank").when(line.startswith("#"), "heading").when(_is_rule(line), "rule")
        .when(bar & F.coalesce(_is_rule(F.col("next")), F.lit(False)), "header").when(bar, "row").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    # a table's header holds until a line that is no part of a table
    rows = rows.withColumn("block", F.count_if(F.col("kind").isin("blank", "heading", "text")).over(so_far))
    rows = rows.withColumn("table_no", F.count_if(F.col("kind") == "header").over(so_far) - 1).withColumn("section_no", F.count_if(F.col("kind") == "heading").over(so_far))
    rows = rows.withColumn("rows", F.count_if(F.col("kind") == "row").over(so_far))
    top = F.struct("block", "rows", _cells(line).alias("cells"))
    rows = rows.withColumn("top", F.last(F.when(F.col("kind") == "header", top), ignorenulls=True).over(so_far))
    rows = rows.withColumn("header", F.when(F.col("top.block") == F.col("block"), F.col("top.cells")))
    rows = rows.withColumn("row_no", F.when(F.col("kind") == "row", F.col("rows") - F.coalesce("top.rows", F.lit(0)) - 1))
    return rows.select(key, "line_no", "line", "kind", "table_no", "section_no", "header", "row_no")


def _with_headers(cells: Column, header: Column) -> Column:
    named = F.transform(cells, lambda c, i: F.when(c != "", F.concat(F.coalesce(F.when(F.try_element_at(header, i + 1) != "", F.concat(F.try_element_at(header, i + 1), F.lit(": "))), F.lit("")), c)))
    return F.array_join(F.filter(named, lambda c: c.isNotNull()), " | ")


def claims_of(told: DataFrame, key: str) -> DataFrame:
    """(key, location, claim, claim_id) from lines: sentences of text, and rows of tables with their headers. Equal claims of a report
    are one; location is its first place (locations, all of them in order)."""
    is_text = F.col("kind") == "text"
    said = F.when(is_text, F.split(F.regexp_replace("line", _PREFIX, ""), f"(?<=[{SENTENCE_ENDS}])")).otherwise(F.array("line"))
    parts = told.where("kind in ('text', 'row')").select(key, "line_no", "kind", "table_no", "row_no", "header", F.posexplode(said).alias("i", "s"))
    shown = F.trim(collapse_space(fold_width(F.col("s"))), F.lit("。！？!?；;，,：:|*-_`> "))
    in_text = F.concat(F.lit("line["), "line_no", F.lit("].sentence["), "i", F.lit("]"))
    in_table = F.concat(F.lit("table["), F.greatest(F.col("table_no"), F.lit(0)), F.lit("].row["), "row_no", F.lit("]"))
    claim = F.when(is_text, shown).otherwise(_with_headers(_cells(F.col("s")), F.col("header")))
    found = parts.select(key, "line_no", "i", F.when(is_text, in_text).otherwise(in_table).alias("location"), claim.alias("claim")).where(claim_like(F.col("claim"))).withColumn("normal", claim_text(F.col("claim")))
    at = F.struct("line_no", "i", "location", "claim")
    merged = found.groupBy(key, "normal").agg(F.min(at).alias("first"), F.transform(F.sort_array(F.collect_list(at)), lambda x: x.location).alias("all"))
    return merged.select(key, F.col("first.location").alias("location"), F.col("first.claim").alias("claim"), F.sha2(F.concat(F.lit(CLAIM_VERSION + "\n"), "normal"), 256).alias("claim_id"), F.array_join("all", ",").alias("locations"))


def parts_of(told: DataFrame, key: str, lead: int = 4) -> DataFrame:
    """(key, part, section_no, place, text) in reading order: the first heading is the title, later ones are headings of sections;
    paragraphs before the first section are the lead, `lead` at most, and what is beyond stays in a section without a heading."""
    text = inline_text(F.regexp_replace("line", "^#{1,6}\\s+", ""))
    rows = told.where("kind in ('heading', 'text', 'header', 'row')").withColumn("text", F.when(F.col("kind").isin("header", "row"), F.array_join(_cells(F.col("line")), " | ")).otherwise(text))
    of = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    early = (F.col("kind") == "text") & (F.col("section_no") <= 1)
    rows = rows.withColumn("n", F.count_if(early).over(of))
    part = (
        F.when((F.col("kind") == "heading") & (F.col("section_no") == 1), "title").when(F.col("kind") == "heading", "section").when(early & (F.col("n") <= lead), "lead")
        .when(F.col("kind") == "text", "paragraph").when(F.col("kind") == "header", "table").otherwise("row")
    )
    return rows.select(key, part.alias("part"), F.greatest(F.col("section_no") - 1, F.lit(0)).cast("long").alias("section_no"), F.col("line_no").cast("long").alias("place"), "text")


#: Words that a formal report doesn't hold.
INFORMAL = (
    "我认为", "大概", "应该是", "显然", "必然", "唯一选择", "全面利好", "重大颠覆",
)
BLOCKED = ("思考过程", "推理过程", "chain-of-thought", "analysis", "scratchpad", "debug", "<think", "</think")


def report_metrics(parts: DataFrame, key: str) -> DataFrame:
    """Lead paragraphs, sections that hold something, tables and rows of each report."""
    of = lambda p: F.count_if(F.col("part") == p)
    sections = F.countDistinct(F.when((F.col("section_no") > 0) & (F.col("text") != ""), F.col("section_no")))
    return parts.groupBy(key).agg(F.count_if((F.col("part") == "lead") & (F.col("text") != "")).alias("lead_paragraphs"), sections.alias("meaningful_sections"), of("table").alias("tables"), of("row").alias("table_rows"))


def structural_issues(parts: DataFrame, key: str, informal: Sequence[str] = INFORMAL, blocked: Sequence[str] = BLOCKED, least_title: int = 6) -> DataFrame:
    """(key, issue, detail) for each report: no clear title, no body, no sections, leftovers of markup, informal and blocked words, empty
    table headers, and rows that don't fit their header."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n")
    of = lambda p: F.count_if(F.col("part") == p)
    cells = F.split("text", " \\| ")
    of_report = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    told = parts.withColumn("of", F.last(F.when(F.col("part") == "table", F.size(cells)), ignorenulls=True).over(of_report))
    crooked = F.count_if((F.col("part") == "row") & (F.size(cells) != F.col("of")))
    blank = F.count_if((F.col("part") == "table") & F.exists(cells, lambda c: F.trim(c) == ""))
    whole = told.groupBy(key).agg(crooked.alias("crooked"), blank.alias("blank"), joined.alias("t"), F.max(F.when(F.col("part") == "title", F.col("text"))).alias("title"), of("section").alias("sections"), F.count_if(F.col("part").isin("lead", "paragraph", "row")).alias("body"))
    left = F.col("t").rlike("(?i)</?(?:report_ir|final_report)|```|\\{\\{.*?\\}\\}")
    bad = [
        ("no_title", F.length(F.coalesce("title", F.lit(""))) < least_title, F.coalesce("title", F.lit(""))),
        ("no_body", F.col("body") == 0, F.lit("")),
        ("no_sections", F.col("sections") == 0, F.lit("")),
        ("markup_left", left, F.lit("")),
        ("informal_words", F.size(hits(F.col("t"), informal)) > 0, F.array_join(hits(F.col("t"), informal), ",")),
        ("blocked_words", F.size(hits(F.lower("t"), blocked)) > 0, F.array_join(hits(F.lower("t"), blocked), ",")),
        ("crooked_table", F.col("crooked") > 0, F.concat(F.lit("rows "), "crooked")),
        ("empty_header", F.col("blank") > 0, F.concat(F.lit("tables "), "blank")),
    ]
    issues = F.filter(F.array(*[F.when(yes, F.struct(F.lit(code).alias("issue"), detail.alias("detail"))) for code, yes, detail in bad]), lambda x: x.isNotNull())
    return whole.select(key, F.explode(issues).alias("x")).select(key, "x.*")


def analysis_depth(reports: DataFrame, key: str, report: str, evidence: str, words: Sequence[str], grounds: Sequence[str], marker: str, headings: str) -> DataFrame:
    """How far a report goes beyond a summary: sentences with an analysing word count 10 each (three at most), those of them whose markers
    all stand in the evidence and that share a ground with it 25 each, headings of analysis 15 each; 100 at most."""
    compact = lambda c: F.regexp_replace(c, "\\s+", "")
    rows = reports.withColumn("ev", compact(F.col(evidence))).withColumn("s", F.filter(F.transform(F.split(F.col(report), "[。！？!?；;.\\n]+"), lambda s: F.trim(s)), lambda s: F.size(hits(s, words)) > 0))
    markers = lambda s: F.regexp_extract_all(s, F.lit(marker), F.lit(0))
    backed = F.filter("s", lambda s: F.forall(markers(s), lambda m: F.contains(F.col("ev"), compact(m))) & F.exists(hits(s, grounds), lambda g: F.contains(F.col("ev"), compact(g))))
    n, k, h = F.size("s"), F.size(backed), F.size(F.regexp_extract_all(F.col(report), F.lit(headings), F.lit(0)))
    score = F.least(F.lit(100), 25 * k + 10 * F.least(n, F.lit(3)) + 15 * h)
    return rows.select(key, score.cast("long").alias("score"), n.cast("long").alias("analysing"), k.cast("long").alias("backed"), ((k < 2) | (score < 50)).alias("summary_only"))


def leaked(reports: DataFrame, key: str, report: str, history: str, evidence: str, marker: str, forbidden: Sequence[str]) -> DataFrame:
    """(key, kind, found): headings that a report must not have, and markers that it shares with the history but not with the evidence."""
    compact = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\s+", "")
    rows = reports.withColumn("m", F.array_distinct(F.regexp_extract_all(F.col(report), F.lit(marker), F.lit(0)))).withColumn("hi", compact(history)).withColumn("ev", compact(evidence))
    facts = rows.select(key, F.lit("fact").alias("kind"), F.explode(F.filter("m", lambda m: F.contains(F.col("hi"), m) & ~F.contains(F.col("ev"), m))).alias("found"))
    return facts.unionByName(rows.select(key, F.lit("heading").alias("kind"), F.explode(hits(F.col(report), forbidden)).alias("found")))


#: Words by which a section tells that its percentages are calculated, and of which column.
CALCULATED, SHARES = ("按表内数据测算", "计算值", "测算"), ("占比", "比例", "百分比")


def cells_without_evidence(parts: DataFrame, key: str, evidence: DataFrame, marker: str, calculated: Sequence[str] = CALCULATED, shares: Sequence[str] = SHARES) -> DataFrame:
    """(key, place, marker) for markers of table rows that no line of the report's evidence (key, line) has together with the row's first
    cell: a number of another row is no support. Percentages of a section that tells how it calculated them need none."""
    cells = F.split("text", " \\| ")
    context = parts.groupBy(key, "section_no").agg((F.bool_or(F.size(hits(F.col("text"), calculated)) > 0) & F.bool_or(F.size(hits(F.col("text"), shares)) > 0)).alias("free"))
    of_rows = parts.where("part = 'row'").join(context, [key, "section_no"])
    rows = of_rows.select(key, "place", "free", F.trim(cells[0]).alias("row_key"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(marker), F.lit(0)))).alias("marker")).where("row_key <> marker and not (free and marker like '%\\%%')")
    found = rows.join(evidence, key).where(F.contains("line", "row_key") & F.regexp_like("line", F.concat(F.lit("(?<![0-9.])\\Q"), "marker", F.lit("\\E(?![0-9])")))).select(key, "place", "marker").distinct()
    return rows.select(key, "place", "marker").join(found, [key, "place", "marker"], "left_anti")
