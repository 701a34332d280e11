"""Reports as text documents, written with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def _paragraph(text: str, style: str = "") -> str:
    kept = "".join(c for c in text if c >= " " or c in "\t\n")
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t xml:space=\"preserve\">{escape(kept)}</w:t></w:r></w:p>"


def docx_bytes(parts: list[tuple[str, str]]) -> bytes:
    """A document of (part, text) in reading order; consecutive table and row parts are one table. The same parts give the same bytes."""
    body, rows = [], []

    def close() -> None:
        if rows:
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r.split(" | ")) + "</w:tr>" for r in rows) + "</w:tbl>")
            rows.clear()

    for part, text in parts:
        if part in ("table", "row"):
            if part == "table":
                close()
            rows.append(text)
            continue
        close()
        body.append(_paragraph(text, {"title": "Title", "section": "Heading1"}.get(part, "")))
    close()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>')):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def rendered(parts: DataFrame, key: str, publishable: Column | None = None) -> DataFrame:
    """(key, content) for the reports of parts (key, part, place, text). Only what is publishable is rendered: a report that isn't gets no
    row, so nothing of it can be written by mistake."""
    rows = parts if publishable is None else parts.where(publishable)
    folded = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "part", "text"))), lambda x: F.struct(x.part, x.text)).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "content": [docx_bytes([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in p]) for p in batch["parts"]]})

    return folded.mapInPandas(run, f"{key} {parts.schema[key].dataType.simpleString()}, content binary")
