"""Files as rows: their text, their tables, and how reading them ended. Files are read whole as bytes by Spark, in whatever store they are,
and parsed in Arrow batches with the standard library; what needs an external program is told as unsupported."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a file, rows of a table that are kept, entries of an archive, and archives inside archives.
MOST_BYTES, MOST_ROWS, MOST_ENTRIES, MOST_DEPTH = 30 << 20, 5_000, 20, 2
SCHEMA = "file string, entry string, kind string, status string, text string, sheet string, n_rows long, rows array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Damaged(ValueError):
    """The bytes are no file of their kind."""


def decoded(data: bytes) -> str:
    return data.decode("utf-8-sig", errors="replace")


def csv_rows(data: bytes) -> tuple[int, list[list[str]]]:
    """The true number of rows, and the first MOST_ROWS."""
    n, kept = 0, []
    for row in csv.reader(io.StringIO(decoded(data), newline="")):
        n += 1
        if len(kept) < MOST_ROWS:
            kept.append([" ".join(c.split()) for c in row])
    return n, kept


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    info = archive.getinfo(name)
    if info.file_size > 8 * MOST_BYTES:
        raise Damaged(f"{name} unpacks to {info.file_size} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise Damaged(f"{name} has a document type")
    return ET.fromstring(data)


def docx_parts(data: bytes, table_rows: int = 10) -> tuple[str, list[list[list[str]]]]:
    """The paragraphs of a text document with the first rows of each table as lines, and its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _xml(archive, "word/document.xml").find(f"{_W}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
    lines, tables = [], []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p" and said(child):
            lines.append(said(child))
        elif child.tag == f"{_W}tbl":
            grid = [[said(c) for c in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            tables.append(grid)
            lines += [" | ".join(row) for row in grid[:table_rows]]
    return "\n".join(lines), tables


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def xlsx_sheets(data: bytes) -> list[tuple[str, int, list[list[str]]]]:
    """(name, true number of rows, first rows) of each sheet; cells stand in their columns, empty ones between them are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in _xml(archive, "xl/sharedStrings.xml").findall(f"{_S}si")]
        targets = {x.get("Id"): x.get("Target", "") for x in _xml(archive, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet"):
            target = targets.get(sheet.get(f"{_R}id"), "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            n, kept = 0, []
            for row in _xml(archive, path).iter(f"{_S}row"):
                n += 1
                if len(kept) >= MOST_ROWS:
                    continue
                cells: list[str] = []
                for cell in row.findall(f"{_S}c"):
                    at = _column(cell.get("r", "")) or len(cells) + 1
                    cells += [""] * (at - 1 - len(cells))
                    value = cell.findtext(f"{_S}v") or ""
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    cells.append(" ".join(value.split()))
                kept.append(cells)
            out.append((sheet.get("name", ""), n, kept))
    return out


def _html_text(data: bytes) -> str:
    text = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ", decoded(data))
    return " ".join(re.sub(r"(?s)<[^>]*>", " ", text).split())


def parsed(name: str, data: bytes, entry: str = "", depth: int = 0) -> Iterator[dict]:
    """The rows of a file, by its extension: one for a text, one for each table, and those of an archive's entries. status: parsed_text,
    parsed_table, empty, too_large, unsupported, parse_failed, skipped."""
    kind = (entry or name).rsplit(".", 1)[-1].lower() if "." in (entry or name) else ""
    row = {"file": name, "entry": entry, "kind": kind, "status": "", "text": None, "sheet": None, "n_rows": None, "rows": None}
    if len(data) > MOST_BYTES:
        yield row | {"status": "too_large"}
        return
    try:
        if kind in ("txt", "md", "json", "xml", "html", "htm"):
            text = _html_text(data) if kind.startswith("htm") else decoded(data)
            yield row | {"status": "parsed_text" if text.strip() else "empty", "text": text}
        elif kind in ("csv", "tsv"):
            n, rows = csv_rows(data)
            yield row | {"status": "parsed_table" if n else "empty", "n_rows": n, "rows": rows, "sheet": "csv"}
        elif kind == "docx":
            text, tables = docx_parts(data)
            yield row | {"status": "parsed_text" if text else "empty", "text": text}
            for i, grid in enumerate(tables):
                yield row | {"status": "parsed_table", "sheet": f"table{i}", "n_rows": len(grid), "rows": grid[:MOST_ROWS]}
        elif kind == "xlsx":
            for sheet, n, rows in xlsx_sheets(data):
                yield row | {"status": "parsed_table" if n else "empty", "sheet": sheet, "n_rows": n, "rows": rows}
        elif kind == "zip" and depth < MOST_DEPTH:
            yield from _entries(name, data, entry, depth)
        else:
            yield row | {"status": "unsupported"}
    except (Damaged, zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, csv.Error):
        yield row | {"status": "parse_failed"}


def _entries(name: str, data: bytes, entry: str, depth: int) -> Iterator[dict]:
    """At most MOST_ENTRIES files of an archive, MOST_BYTES in all; those that would leave the folder, or are beyond, are skipped and told."""
    left = MOST_BYTES
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        files = [x for x in archive.infolist() if not x.is_dir()]
        for i, info in enumerate(files):
            inner = f"{entry}!{info.filename}" if entry else info.filename
            unsafe = info.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", info.filename)
            if i >= MOST_ENTRIES or unsafe or info.file_size > left:
                yield {"file": name, "entry": inner, "kind": "", "status": "skipped", "text": None, "sheet": None, "n_rows": None, "rows": None}
                continue
            left -= info.file_size
            yield from parsed(name, archive.read(info), inner, depth + 1)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The rows of all files of a folder that match the pattern. A file above MOST_BYTES is told by its size and never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    large = files.where(F.col("length") > MOST_BYTES).select(name.alias("file"), F.lit("").alias("entry"), F.lower(F.element_at(F.split(name, "\\."), -1)).alias("kind"), F.lit("too_large").alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("sheet", "string"), ("n_rows", "long"), ("rows", "array<array<string>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.list_(pa.list_(pa.string()))]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in parsed(file, data or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, kinds, strict=True)], names=names)

    small = files.where(F.col("length") <= MOST_BYTES).select(name.alias("file"), "content")
    return small.mapInArrow(run, SCHEMA).unionByName(large)


def cells_of(parsed_files: DataFrame) -> DataFrame:
    """(file, entry, sheet, row_no, cells) of all tables, for header election and profiles; row_no from 0."""
    return parsed_files.where("rows is not null").select("file", "entry", "sheet", F.posexplode("rows").alias("row_no", "cells"))


def docx_texts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, text) of text documents that are held in a column of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [docx_parts(x)[0] for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(key, content).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
