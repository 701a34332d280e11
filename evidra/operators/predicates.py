"""Guards and structural predicates as column functions. Keyword lists are arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import hits


def safe_id(c: Column, kind: str) -> Column:
    """Whether an id is of its kind and holds nothing but letters, digits, dashes and underscores."""
    return c.rlike(f"\\A{kind}_[A-Za-z0-9_-]{{1,80}}\\z")


def valid_url(c: Column) -> Column:
    return c.rlike("^https?://[^/\\s]+")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^https?://([^/?#:]+)", 1))


def normal_url(c: Column) -> Column:
    """Without its fragment and the slashes at its end."""
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")


def url_for_log(c: Column) -> Column:
    """Without query and fragment, which may hold tokens."""
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "\\?.*$", "")


def login_page(html: Column) -> Column:
    """Whether a page asks for a login instead of showing what was wanted."""
    return F.lower(html).rlike('type="?password|name="?passw|login|sign in')


def first_keyword(c: Column, pairs: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The kind of the first keyword, in the order of the pairs, that the text holds."""
    out = F.lit(otherwise)
    for word, kind in reversed(list(pairs)):
        out = F.when(F.contains(c, F.lit(word)), kind).otherwise(out)
    return out


def usable(status: Column, all_statuses: Column, good: Sequence[str], final: Sequence[str] = ()) -> Column:
    """Whether a file can be used: by its status or any earlier one; a status in `final` decides against it."""
    either = status.isin(*good) | F.arrays_overlap(all_statuses, F.array(*map(F.lit, good)))
    return F.when(status.isin(*final), False).otherwise(either) if final else either


def attachment_led(content_chars: Column, children: Column, least_body: int = 800, least_children: int = 800) -> Column:
    """Whether a record lives by its files: a short body, and one usable core file whose texts are long enough. children: an array
    of structs (core, usable, chars)."""
    return (content_chars < least_body) & F.exists(children, lambda x: x.core & x.usable & (x.chars >= least_children))


def rich(c: Column, words: Sequence[str], least_hits: int = 4, least_chars: int = 300) -> Column:
    """Whether a text holds enough: several of the words, and characters other than white space."""
    return (F.size(hits(c, words)) >= least_hits) & (F.length(F.regexp_replace(c, "\\s+", "")) >= least_chars)


def fragmentary(c: Column, least_chars: int) -> Column:
    return F.length(F.regexp_replace(c, "\\s+", "")) < least_chars


def cut_off(c: Column) -> Column:
    """Whether a text seems to end in the middle: its last line is neither a sentence, a table row nor a heading."""
    last = F.trim(F.element_at(F.split(F.trim(c, F.lit(" \n")), "\n"), -1))
    return (last != "") & ~last.rlike("[。.!！?？；;:：|)）」”\"*`]$") & ~last.rlike("^#")


def title_like(c: Column, most: int = 60) -> Column:
    """Whether a line can be a title: short, no list or table, no sign at its end."""
    line = F.trim(c)
    return (F.length(line) >= 4) & (F.length(line) <= most) & ~line.rlike("^[-*+|>\\d]") & ~line.rlike("[。.!！?？；;:：,，]$")


def applicable(menu: Column, code: Column, title: Column, category: Column, menus: Sequence[str], codes: Sequence[str], title_words: Sequence[str], category_words: Sequence[str]) -> Column:
    """Whether rules of a domain apply to a record: its menu or code belongs to it, and its title or category names it."""
    named = (F.size(hits(F.coalesce(title, F.lit("")), title_words)) > 0) | (F.size(hits(F.coalesce(category, F.lit("")), category_words)) > 0)
    return (menu.isin(*menus) | code.isin(*codes)) & named


def ocr_candidate(scanned: Column, chars: Column, table_readable: Column, least: int = 200) -> Column:
    return scanned & ((chars < least) | ~table_readable)
