"""Web pages: title, main text, and links to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import collapse_space, hits, html_text

#: Where a notice's text stands, in order (classes of elements, then an element), and endings of files.
MAIN_CLASSES, MAIN_TAG, LEAST_MAIN = ("els-messageinfo-box", "detailPage", "els-contentCon", "contentCon", "article-content", "detail-content", "TRS_Editor"), "article", 80
ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip", ".rar")
LINK_WORDS, GENERIC = ("附件", "下载", "表", "清单", "目录", "采购文件", "承诺书", "采购需求量"), ("附件下载", "下载", "下载中心")


def _element(html: Column, tag: str, wanted: str = "") -> Column:
    """The inside of the first element; an element of the same name inside it ends it early."""
    return F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*{wanted}[^>]*>(.*?)</{tag}>", 1)


def page_title(html: Column) -> Column:
    """The text of the first heading, else of the title."""
    heading, title = html_text(_element(html, "h1")), html_text(_element(html, "title"))
    return F.when(heading != "", heading).otherwise(title)


def main_text(html: Column, classes: Sequence[str] = MAIN_CLASSES, tag: str = MAIN_TAG, least: int = LEAST_MAIN) -> Column:
    """The text of the first place that has at least so many characters, else of the body (or of all, without one)."""
    places = [html_text(_element(html, "div", f"class=\"[^\"]*\\b{c}\\b[^\"]*\"")) for c in classes] + [html_text(_element(html, tag))]
    body = html_text(_element(html, "body"))
    out = F.when(body != "", body).otherwise(html_text(html))
    for place in reversed(places):
        out = F.when(F.length(place) >= least, place).otherwise(out)
    return out


def resolved(base: Column, href: Column) -> Column:
    """The absolute address of a link on a page."""
    origin, folder = F.regexp_extract(base, "^(https?://[^/?#]+)", 1), F.regexp_extract(base, "^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(base, "^(https?:)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))


def file_links(pages: DataFrame, key: str, url: str, html: str, endings: Sequence[str] = ENDINGS, words: Sequence[str] = LINK_WORDS, generic: Sequence[str] = GENERIC, most: int = 20) -> DataFrame:
    """(key, place, link, said): links whose path or query names a file, or whose text tells of one; generic texts alone don't. Each
    address once, by its first place, `most` for a page."""
    anchor = "(?is)<a\\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("inner"))
    rows = pages.select(key, url, F.posexplode(both).alias("place", "x")).select(key, url, "place", F.trim("x.href").alias("href"), html_text(F.col("x.inner")).alias("said"))
    rows = rows.where((F.col("href") != "") & ~F.col("href").rlike("^(?:javascript:|mailto:|#)")).withColumn("link", resolved(F.col(url), F.col("href")))
    path, query = F.lower(F.regexp_extract("link", "^https?://[^/?#]+([^?#]*)", 1)), F.lower(F.regexp_extract("link", "\\?([^#]*)", 1))
    file = F.exists(F.array(*map(F.lit, endings)), lambda e: path.endswith(e) | F.contains(query, e))
    told = (F.size(hits(F.col("said"), words)) > 0) & ~collapse_space(F.col("said")).isin(*generic)
    first = rows.where(file | told).groupBy(key, "link").agg(F.min(F.struct("place", "said")).alias("x"))
    ranked = first.select(key, "link", "x.said", F.row_number().over(Window.partitionBy(key).orderBy("x.place")).cast("long").alias("place"))
    return ranked.where(F.col("place") <= most).select(key, "place", "link", "said")
