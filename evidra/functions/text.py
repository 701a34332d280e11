"""Text column functions: cleaning, cutting, counting and scanning. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[ \\t\\n\\r\\x0b\\x0c]+"


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def html_text(c: Column, hidden: Sequence[str] = ("script", "style", "noscript", "svg")) -> Column:
    """Text of a page without hidden elements; tags become spaces, the five basic entities are resolved."""
    for tag in hidden:
        c = F.regexp_replace(c, f"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return collapse_space(c)


def truncate_head_tail(c: Column, limit: int | Column, marker: str = " [...] ") -> Column:
    """At most limit characters: 65 % from the start and the rest from the end, with a marker between (beyond the limit)."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit * 65 / 100).cast("int")
    tail = F.when(limit > head, c.substr((F.length(c) - (limit - head) + 1).cast("int"), (limit - head).cast("int"))).otherwise("")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(c.substr(F.lit(1), head), F.lit(marker), tail))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of at least so many characters; the delimiter goes."""
    parts = F.transform(F.split(c, "[.!?\\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def hits(c: Column, words: Sequence[str]) -> Column:
    """Those of the words that occur, as listed."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def latin_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def terms(c: Column, least: int) -> Column:
    """Distinct runs of at least so many letters a-z, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


#: Full-width signs and the space that goes with them, and what NFKC makes of them (a rule, not a list).
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  "


def fold_width(c: Column) -> Column:
    """Full-width letters, digits and signs as ASCII. Of NFKC this is the part that Chinese notices need; it stays in the JVM."""
    return F.translate(c, _WIDE, _NARROW)


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode normalisation NFKC, batch by batch; for texts with other compatibility signs than full-width ones."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Fixed value: signs that don't count at the ends of a claim.
CLAIM_ENDS = "。！？!?；;，,：:|*-_`> "


def claim_text(c: Column) -> Column:
    """A claim as it is compared: width folded, white space deleted, signs at its ends stripped."""
    return F.trim(F.regexp_replace(fold_width(c), "\\s+", ""), F.lit(CLAIM_ENDS))


def match_text(c: Column) -> Column:
    """For comparisons of loose texts: without tags, white space, and the signs - / . that dates differ in; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "[\\s\\-/.]+", ""))


def clean_paragraphs(c: Column) -> Column:
    """No-break spaces and tabs as spaces, runs of spaces as one, at most one blank line in a row."""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), "[ \\t\\x0b\\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, " *\n *", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def kept_sentences(c: Column, ends: str = "。！？!?；;.", least: int = 1) -> Column:
    """Sentences with the sign that ends them."""
    parts = F.transform(F.split(c, f"(?<=[{ends}])\\s*|\\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def visible_text(c: Column) -> Column:
    """What a reader of a Markdown text sees: without tags, code blocks, images, targets of links, and signs of markup."""
    for pattern, to in (("<[^>]+>", ""), ("(?s)```.*?```", " "), ("`([^`]*)`", "$1"), ("!\\[[^\\]]*\\]\\([^)]+\\)", " "), ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("(?m)^[#>\\-*+\\s]+", ""), ("\\|", " "), ("[*_~]+", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


_CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def reader_words(c: Column) -> Column:
    """Words as an office program counts them: Chinese characters one by one, and runs of Latin letters and digits."""
    seen = visible_text(c)
    count = lambda p: F.size(F.regexp_extract_all(seen, F.lit(p), F.lit(0)))
    return (count(_CJK) + count("[A-Za-z0-9]+(?:[./:_-][A-Za-z0-9]+)*")).cast("long")


#: What models put around an answer.
_THOUGHTS = "(?is)<think(?:ing)?\\b[^>]*>.*?</think(?:ing)?>"
_PREAMBLE = "(?i)\\A\\s*(?:(?:(?:sure|certainly|here is|here's)\\b|以下是|好的)[^\n]{0,80}[:：]|(?:sure|certainly|好的)[!！.。]?)[^\\S\n]*(?:\n|\\z)"


def answer_text(c: Column) -> Column:
    """A model's answer without reasoning blocks (an open one reaches to the end), code fences around it and the preamble: a first line that
    only agrees, or that announces the answer and ends in a colon. Lines further on are part of the answer, however they begin."""
    c = F.regexp_replace(F.regexp_replace(c, _THOUGHTS, ""), "(?is)<think(?:ing)?\\b[^>]*>.*$", "")
    c = F.regexp_replace(F.regexp_replace(F.trim(c, F.lit(" \n\t")), "(?s)^```[a-zA-Z]*\\s*\n(.*?)\n?```\\s*$", "$1"), _PREAMBLE, "")
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"), F.lit(" \n"))


def inline_text(c: Column) -> Column:
    """One line of plain text: template variables, tags and markup signs go, white space collapses."""
    c = F.regexp_replace(F.regexp_replace(c, "(?s)\\{\\{.*?\\}\\}", ""), "<[^>]+>", "")
    return collapse_space(F.regexp_replace(F.regexp_replace(c, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), "[*_`~]{1,3}|^\\s*(?:#{1,6}|>|[-+])\\s+", ""))


def file_name(c: Column, most: int = 80) -> Column:
    """A name that file systems accept: forbidden signs become underscores, dots and spaces at the ends go."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, "[\\\\/:*?\"<>|\\x00-\\x1f]+", "_"), "\\s+", " "), F.lit(" ._"))
    return F.when(clean == "", "report").otherwise(F.trim(F.substring(clean, 1, most), F.lit(" .")))


def within_chars(parts: Sequence[Column], budget: int, mark: str = "\n\n") -> Column:
    """The non-empty parts in order, joined, cut to a budget of characters from both ends."""
    return truncate_head_tail(F.concat_ws(mark, *[F.when(F.trim(p) != "", p) for p in parts]), budget)


def json_chars(fields: dict[str, Column]) -> Column:
    """How many characters a flat record has as JSON with a space after each colon and comma (nulls count as null)."""
    record = F.struct(*[c.alias(n) for n, c in fields.items()])
    return (F.length(F.to_json(record, {"ignoreNullFields": "false"})) + 2 * len(fields) - 1).cast("long")


def canonical_hash(fields: dict[str, Column]) -> Column:
    """sha256 of a flat record as JSON with its keys in order and no spaces."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def with_own_size(base: Column) -> Column:
    """The size of a record that holds its own size, from its size without the digits of that number: the least one that is true."""
    return (base + F.get(F.filter(F.sequence(F.lit(1), F.lit(19)), lambda k: F.length((base + k).cast("string")) == k), F.lit(0))).cast("long")


def without_sections(c: Column, headings: Sequence[str]) -> Column:
    """A Markdown text without the sections whose headings hold one of the words; a section ends at the next heading."""
    words = "|".join(re.escape(h) for h in headings)
    return F.trim(F.regexp_replace(c, f"(?ms)^#{{1,6}}[^\n]*(?:{words})[^\n]*\n?.*?(?=^#{{1,6}}\\s|\\z)", ""), F.lit(" \n"))


def glossary_entries(c: Column) -> Column:
    """The entries of a glossary paragraph as `term: meaning`, whatever marks stand before the term and between the two; each once."""
    lines = F.transform(F.split(c, "[\n；;]+"), lambda x: F.regexp_replace(F.trim(x), "^(?:[-*+•]|\\d+[.)、])\\s*", ""))
    entries = F.transform(lines, lambda x: F.regexp_replace(x, "^\\**([^:：*—-]{1,40}?)\\**\\s*(?:[:：]|—+|-{2,})\\s*", "$1: "))
    return F.array_distinct(F.filter(entries, lambda x: x.rlike("^[^:]{1,40}: .")))


def important_parts(c: Column, topics: Sequence[tuple[str, Sequence[str]]], words: Sequence[str], each: int = 500, most: int = 12, least: int = 12) -> Column:
    """What matters of a text, as an array: for each topic that it has, its first three sentences; then other sentences with one of the
    words, that no topic has said already; `most` in all. One pass over the sentences of a row, nothing is dealt out."""
    has = lambda w: lambda s: F.size(hits(s, w)) > 0

    def parts(told: Column, named: Column) -> Column:
        rest = F.filter(told, lambda s: (F.size(hits(s, words)) > 0) & ~F.exists(named, lambda p: F.contains(p, s)))
        return F.slice(F.concat(named, F.transform(rest, lambda s: F.substring(s, 1, each))), 1, most)

    def sections(told: Column) -> Column:
        found = [(n, F.filter(told, has(w))) for n, w in topics]
        return F.array_compact(F.array(*[F.when(F.size(x) > 0, F.concat(F.lit(f"{n}: "), F.substring(F.array_join(F.slice(x, 1, 3), "; "), 1, each))) for n, x in found]))

    # variables of lambdas are computed once for each row; columns used in several places would be computed in each
    once = lambda x, f: F.transform(F.array(x), f)[0]
    return once(sentences(c, least), lambda told: once(sections(told), lambda named: parts(told, named)))
