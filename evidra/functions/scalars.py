"""Dates, numbers, levels, tiers and budgets as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence levels by the number of weighted characters below which they end, and the length of a report for each.
LEVELS = (("low", 1000, "600-1000"), ("medium", 5000, "1000-1800"), ("high", 12000, "1800-3000"), ("very_high", None, "3000+"))


def evidence_level(weighted: Column) -> Column:
    """low below 1000, medium below 5000, high below 12000, else very_high."""
    out = F.lit(LEVELS[-1][0])
    for name, below, _ in reversed(LEVELS[:-1]):
        out = F.when(weighted < below, name).otherwise(out)
    return out


def report_length(level: Column) -> Column:
    """Characters that a report of this evidence level should have, as a range."""
    out = F.lit(None).cast("string")
    for name, _, said in LEVELS:
        out = F.when(level == name, said).otherwise(out)
    return out


def compression_tier(chars: Column, limit: int = 80_000) -> Column:
    """none up to the limit, light up to 10,000 above it, medium up to 150,000, else strong."""
    return F.when(chars <= limit, "none").when(chars <= limit + 10_000, "light").when(chars <= 150_000, "medium").otherwise("strong")


#: How far below the limit the floor and the ceiling of a tier lie.
WINDOWS = (("light", 2_000, 500), ("medium", 10_000, 1_000), ("strong", 5_000, 1_000))


def tier_window(chars: Column, limit: int = 80_000) -> Column:
    """Floor and ceiling of what a size is compressed to: the size itself where none is needed, 1,000 at least elsewhere."""
    tier = compression_tier(chars, limit)
    floor = ceiling = F.greatest(chars, F.lit(0))
    for name, low, high in WINDOWS:
        floor = F.when(tier == name, F.lit(max(1_000, limit - low))).otherwise(floor)
        ceiling = F.when(tier == name, F.lit(max(1_000, limit - high))).otherwise(ceiling)
    return F.struct(floor.cast("long").alias("floor"), ceiling.cast("long").alias("ceiling"))


def input_strategy(primaries: Column, attachment_led: Column, table_heavy: Column, relevant: Column, full: int = 65_000, safe: int = 75_000, hard: int = 80_000) -> Column:
    """Ordered rules: several primaries, then the structure of the only one, then the size of what is relevant."""
    by_size = F.when(relevant <= full, "full_input").when(relevant <= safe, "light_compact").when(relevant <= hard, "safe_compact").otherwise("staged_generation")
    return F.when(primaries >= 2, "staged_generation").when(attachment_led, "attachment_led").when(table_heavy, "table_heavy").otherwise(by_size)


def strategy_type(strategy: Column) -> Column:
    structure = strategy.isin("attachment_led", "table_heavy")
    return F.when(structure, "structure_based").when(strategy == "staged_generation", "complexity_based").otherwise("size_based")


def target_length(primaries: Column, auxiliaries: Column, content_chars: Column, attachments: Column, attachment_led: Column) -> Column:
    """The range of characters that a report should have, by what it is made from."""
    alone = (primaries == 1) & (auxiliaries == 0)
    brief = alone & (content_chars < 800) & (attachments == 0)
    return F.when(brief, "800-1200").when(alone & attachment_led, "1500-2500").when((primaries >= 2) | (auxiliaries >= 2), "3000-5000").otherwise("1800-3000")


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")


#: Fixed value: a date of this century with its separators.
DATE = "(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})日?"


def normal_date(c: Column) -> Column:
    """YYYY-MM-DD of the first date; null if there is none or the calendar has no such day."""
    part = lambda k: F.regexp_extract(c, DATE, k)
    return F.date_format(F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def dates(c: Column, most: int = 20) -> Column:
    """Dates of this century as they are written: first without spaces, then those spelled with spaces allowed; repeats stay."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in ("20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?", "20[0-9]{2}\\s*年\\s*[0-9]{1,2}\\s*月\\s*[0-9]{1,2}\\s*日")]
    return F.slice(F.concat(*found), 1, most)


def iso_timestamp(c: Column) -> Column:
    """An ISO time as UTC without zone: an offset is applied, a time without one is taken as UTC; null if it is none."""
    clean = F.trim(c)
    return F.when(clean.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(F.regexp_replace(clean, "^([0-9-]{10})[ T]", "$1 ")))


#: Units of durations.
UNITS = (("年", "Y"), ("year", "Y"), ("个月", "M"), ("月", "M"), ("month", "M"), ("天", "D"), ("日", "D"), ("day", "D"))


def normal_duration(c: Column, legacy: bool = False) -> Column:
    """P2Y, P6M, P30D of the first number with a unit. Zeros are stripped after a decimal point only; legacy strips them from whole
    numbers as well, so that 10 years become P1Y (but 10.0 years P10Y, as only the zeros of the fraction are met)."""
    pattern = "([0-9]+(?:\\.[0-9]+)?)\\s*(" + "|".join(w for w, _ in UNITS) + ")"
    number, unit = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    if legacy:
        trimmed = F.regexp_replace(F.regexp_replace(number, "0+$", ""), "\\.$", "")
    else:
        trimmed = F.regexp_replace(F.regexp_replace(number, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    sign = F.lit(None).cast("string")
    for word, letter in UNITS:
        sign = F.when(unit == word, letter).otherwise(sign)
    return F.concat(F.lit("P"), trimmed, sign)


#: Seconds and percents between which the progress of a run rises in straight lines.
PROGRESS = ((0, 35), (5, 45), (20, 65), (60, 82), (180, 90))


def progress_percent(terminal: Column, elapsed: Column) -> Column:
    """100 at the end; before, 35 rising over the seconds to 90 at most; 35 where the start isn't known."""
    out = F.lit(float(PROGRESS[-1][1]))
    for (t0, p0), (t1, p1) in reversed(list(zip(PROGRESS, PROGRESS[1:]))):
        out = F.when(elapsed <= t1, p0 + (F.greatest(elapsed, F.lit(0)) - t0) / (t1 - t0) * (p1 - p0)).otherwise(out)
    return F.when(terminal, F.lit(100)).when(elapsed.isNull(), F.lit(35)).otherwise(F.floor(out)).cast("long")


def money_forms(marker: Column, context: Column, units: tuple[str, ...] = ("（元）", "(元)", "单位：元", "单位:元", "价格（元", "价格(元")) -> Column:
    """The bare numbers by which an amount may stand in a table whose context names the unit."""
    said = F.exists(F.array(*map(F.lit, units)), lambda u: F.contains(context, u))
    found = F.regexp_extract_all(marker, F.lit("(?<![0-9])([0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?)\\s*(?:万元|元)"), F.lit(1))
    bare = F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))
    return F.when(said, bare).otherwise(F.array().cast("array<string>"))


def has_number(line: Column, number: str | Column) -> Column:
    """Whether the number stands in the line by itself, not as a part of a longer one; zeros after its point don't matter."""
    number = F.replace(F.lit(number) if isinstance(number, str) else number, F.lit(","), F.lit(""))
    quoted = F.concat(F.lit("(?<![0-9.])\\Q"), number, F.lit("\\E(?:\\.0+)?(?![0-9.])"))
    return (number != "") & F.regexp_like(F.replace(line, F.lit(","), F.lit("")), quoted)


def table_score(flags: Column, fields: Column, rows: Column, heavy: Column) -> Column:
    """How much evidence a table holds: 8 for each of its flags up to 35, 6 for each profiled field up to 35, and its size."""
    return (F.least(F.lit(35), 8 * flags) + F.least(F.lit(35), 6 * fields) + F.when(heavy, 20).otherwise(0) + F.when(rows >= 5000, 10).otherwise(0)).cast("long")


def acceptance_score(answer: Column, downloaded: Column, failures: tuple[str, ...] = ("报告解析失败", "无法导出"), open_check: str = "质检状态：needs_fix", least: int = 1200) -> Column:
    """100 less 35 for a failure phrase, 10 for an open check, 15 for a short text (without white space) and 25 without a file."""
    less = lambda yes, n: F.when(yes, n).otherwise(0)
    text = F.coalesce(answer, F.lit(""))
    failed = F.exists(F.array(*map(F.lit, failures)), lambda p: F.contains(text, p))
    brief = F.length(F.regexp_replace(text, "\\s+", "")) < least
    return F.greatest(F.lit(0), 100 - less(failed, 35) - less(F.contains(text, F.lit(open_check)), 10) - less(brief, 15) - less(~F.coalesce(downloaded, F.lit(False)), 25)).cast("long")


#: How much the characters of a pack's parts weigh, in tenths: content and facts of primary records, summaries and tables of their
#: files, snippets, summaries and content of auxiliary records, summaries and tables of their files.
WEIGHTS = (10, 10, 7, 6, 5, 3, 2, 3, 3)


def weighted_chars(parts: list[Column]) -> Column:
    """The weighted sum of nine numbers of characters, cut to a whole number."""
    if len(parts) != len(WEIGHTS):
        raise ValueError(f"{len(WEIGHTS)} parts are weighed")
    total = F.lit(0)
    for part, weight in zip(parts, WEIGHTS, strict=True):
        total = total + weight * F.coalesce(part, F.lit(0))
    return F.floor(total / 10).cast("long")


def file_score(primary: Column, core: Column, business: Column, hits: Column, status: Column, tables: Column) -> Column:
    """How much evidence a file holds: 40 for one of a primary record (else 12), 35 for a core one, 20 for one of the business, 2 for each
    word up to 25, 15 if it was read and 8 less if it wasn't, and what its tables hold up to 40; 0 at least."""
    read = F.when(status.isin("parsed_text", "parsed_summary", "parsed_table_summary", "temp_file_parsed"), 15).when(status.isin("metadata_only", "download_failed", "parse_failed", "unsupported"), -8).otherwise(0)
    score = F.when(primary, 40).otherwise(12) + F.when(core, 35).otherwise(0) + F.when(business, 20).otherwise(0) + F.least(F.lit(25), 2 * hits) + read
    return F.greatest(F.lit(0), score + F.least(F.lit(40), tables)).cast("long")


def record_score(primary: Column, hits: Column, relevance: Column, files: Column) -> Column:
    """How much evidence a record holds: 60 for a primary one (else 15 and 20 times its relevance), 2 for each word up to 30, and of the scores
    of its files (an array) the best one and a fifth of the first three, 70 at most; 0 at least."""
    best = F.when(F.size(files) > 0, F.least(F.lit(70), F.array_max(files) + F.floor(F.aggregate(F.slice(files, 1, 3), F.lit(0).cast("long"), lambda a, b: a + b) / 5))).otherwise(0)
    score = F.when(primary, 60).otherwise(15 + F.floor(F.coalesce(relevance, F.lit(0.0)) * 20)) + F.least(F.lit(30), 2 * hits) + best
    return F.greatest(F.lit(0), score).cast("long")
