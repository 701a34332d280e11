"""JSON documents: strings in them, answers of providers, reports as JSON; parsed with the standard library in batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from evidra.operators.gates import first_object

#: States of a workflow that failed, and keys under which its output may lie.
FAILED = ("failed", "stopped", "error", "exception", "partial-succeeded")
OUTPUT_KEYS = ("report_markdown", "markdown", "text", "result", "output", "answer")
#: Keys of a report that no reader may see.
HIDDEN = ("thinking", "reasoning", "analysis", "scratchpad", "debug", "chain_of_thought")


def _mapped(rows: DataFrame, key: str, column: str, schema: str, f: Callable[[str], tuple]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [f(x if isinstance(x, str) else "") for x in batch[column]]
            yield pd.DataFrame({key: batch[key], **{n: [r[i] for r in found] for i, n in enumerate(names)}})

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def strings_in(value, ordered: bool = True) -> list[str]:
    """All texts in a JSON value: objects by their keys in order (or as they stand), arrays as they stand; numbers as text."""
    if isinstance(value, dict):
        return [s for k in (sorted(value) if ordered else value) for s in strings_in(value[k], ordered)]
    if isinstance(value, list):
        return [s for x in value for s in strings_in(x, ordered)]
    text = "" if value is None or value is False else str(value).strip()
    return [text] if text else []


def flattened(rows: DataFrame, key: str, column: str, ordered: bool = True, mark: str = " ") -> DataFrame:
    """(key, flat, n): the texts of a JSON column, joined; a column that is no JSON counts as one text."""

    def flat(raw: str) -> tuple[str, int]:
        try:
            found = strings_in(json.loads(raw), ordered)
        except ValueError:
            found = strings_in(raw)
        return mark.join(found), len(found)

    return _mapped(rows, key, column, "flat string, n long", flat)


def unwrapped(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, run_id, text, failure) of a provider's response: outputs under data or at the top, as an object or as a text that holds one.
    failure: output_schema_invalid, workflow_failed, workflow_id_missing, output_empty, output_truncated, or empty."""

    def unwrap(raw: str) -> tuple[str, str, str]:
        try:
            response = json.loads(raw)
        except ValueError:
            response = None
        data = response.get("data", {}) if isinstance(response, dict) else None
        if not isinstance(data, dict):
            return "", "", "output_schema_invalid"
        if str(data.get("status") or response.get("status") or "").strip().lower() in FAILED:
            return "", "", "workflow_failed"
        run = str(response.get("workflow_run_id") or data.get("id") or data.get("workflow_run_id") or "").strip()
        if not run:
            return "", "", "workflow_id_missing"
        outputs = data["outputs"] if "outputs" in data else response.get("outputs")
        for _ in range(4):  # a text may hold an object that holds another one
            if isinstance(outputs, str):
                inner = first_object(outputs)
                if not inner:
                    break
                outputs = json.loads(inner)
            elif isinstance(outputs, dict) and not isinstance(outputs.get("report_markdown"), str):
                outputs = next((outputs[k] for k in OUTPUT_KEYS if outputs.get(k)), None)
            else:
                break
        text = outputs.get("report_markdown", "") if isinstance(outputs, dict) else outputs if isinstance(outputs, str) else ""
        if not text.strip():
            return run, "", "output_empty" if outputs in (None, "", {}) or isinstance(outputs, str | dict) else "output_schema_invalid"
        cut = str(data.get("finish_reason") or (outputs.get("finish_reason") if isinstance(outputs, dict) else "") or "").lower() in ("length", "max_tokens")
        return run, text, "output_truncated" if cut else ""

    return _mapped(rows, key, column, "run_id string, text string, failure string", unwrap)


def repaired_json(text: str) -> dict | None:
    """The object of a text, if need be with quotes inside its strings escaped: a quote ends a string only before , : } or ]."""
    body = first_object(text)
    if not body:
        start, end = (text or "").find("{"), (text or "").rfind("}")
        if start < 0 or end < start:
            return None
        out, inside, raw = [], False, text[start : end + 1]
        for i, c in enumerate(raw):
            if c == '"' and (i == 0 or raw[i - 1] != "\\"):
                if not inside:
                    inside = True
                elif re.match(r"\s*[,:}\]]", raw[i + 1 :]):
                    inside = False
                else:
                    out.append("\\")
            out.append(c)
        body = "".join(out)
    try:
        value = json.loads(body)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def walk(report: dict) -> list[tuple[str, str]]:
    """(location, text) of a report in reading order; hidden keys aren't read."""
    found: list[tuple[str, str]] = []

    def add(location: str, value) -> None:
        if isinstance(value, list):
            for i, x in enumerate(value):
                add(f"{location}[{i}]", x)
        elif isinstance(value, dict):
            for k, x in value.items():
                if k.lower() not in HIDDEN:
                    add(f"{location}.{k}" if location else k, x)
        elif value is not None and str(value).strip():
            found.append((location, " ".join(str(value).split())))

    add("", report)
    return found


def report_texts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, location, text) for every text of a report in JSON, wrapped in prose, thoughts or a fence; also under report_ir or report."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, raw in zip(batch[key], batch[column], strict=True):
                value = repaired_json(raw if isinstance(raw, str) else "")
                value = next((value[x] for x in ("report_ir", "report") if value and isinstance(value.get(x), dict)), value)
                out += [(k, where, text) for where, text in walk(value or {})]
            yield pd.DataFrame(out, columns=[key, "location", "text"])

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, location string, text string")
