"""Packs of several versions, rules as tables, parts of packs."""

import json

import pytest

from evidra.operators import packs, rules, versions

TEXT = "The  cycle is two years. Price below ten."
V1 = {
    "primary_materials": [{"title": " Notice ", "content_text": TEXT, "summary": "", "key_facts": [{"name": "cycle", "value": "cycle is two"}, {"name": "none", "value": "three years"}, {"name": "blank", "value": " "}], "attachments": [{"filename": "a.xlsx", "summary": "A table", "warnings": ["cut", ""]}]}],
    "auxiliary_materials": [{"content_text": TEXT, "title": None}], "warnings": ["late"], "generation_guidance": {"topic": "x"}, "report_focus": ["lost"], "sources": 1,
}
V2 = {"evidence_schema_version": 2, "evidence_items": [{"level": "A", "kind": "article_text", "value": "t", "mandatory": True}, {"level": "A", "kind": "article_text", "value": "t"}, {"level": "C", "kind": "summary", "value": ""}], "other": 1}


def test_versions(spark):
    docs = [(1, json.dumps(V1)), (2, json.dumps(V2)), (3, '{"evidence_schema_version": 9}'), (4, '{"cut'), (5, "[1]"), (6, None), (7, "{}"), (8, '{"evidence_schema_version": 2}')]
    told = versions.parsed(spark.createDataFrame(docs, "id int, raw string"), "id", "raw")
    got = {r["pack"]: (r["version"], r["problem"], r["lost"]) for r in told.drop("doc").collect()}
    assert got[1] == (1, None, ["report_focus", "sources"]) and got[2] == (2, None, []) and got[3][1] == "unknown_version" and got[7] == (1, None, []) and got[8][1] == "no_items"
    assert {got[k][1] for k in (4, 5, 6)} == {"not_an_object"}
    found = versions.items(told).collect()
    of = lambda k: sorted((r["level"], r["kind"], r["value"], r["mandatory"]) for r in found if r["pack"] == k)
    assert of(1) == [
        ("A", "article_field", "Notice", False), ("A", "article_text", TEXT, True), ("B", "derived_fact", "cycle is two", False),
        ("C", "guidance", '{"topic":"x"}', False), ("C", "summary", "A table", False), ("C", "summary", "three years", False), ("C", "warning", "cut", False), ("C", "warning", "late", False),
    ]
    assert of(2) == [("A", "article_text", "t", True)] and not of(3) and not of(7)
    assert {r["level"] for r in versions.supporting(versions.items(told)).collect()} == {"A", "B"}


GOOD = [
    ("version", 0, "version", "3"), ("trigger", 0, "menu_names", "notices"), ("topics", 0, "topic_id", "cycle"), ("topics", 0, "presentation", "table"), ("topics", 0, "failure_code", "NO_CYCLE"), ("topics", 0, "labels", "term"), ("topics", 0, "labels", "cycle of purchase"),
    ("phrases", 0, "phrase", "see the file"), ("sections", 0, "section_id", "facts"), ("sections", 0, "labels", "Facts"),
]


def test_rules_are_checked_and_versioned(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, rules.SCHEMA)
    (tmp_path / "rules.json").write_text("\n".join(json.dumps(dict(zip(("section", "entry", "field", "value"), r, strict=True))) for r in reversed(GOOD)))
    told, version = rules.checked(rules.read_rules(spark, f"file://{tmp_path}/rules.json"))
    assert told.topics == (("cycle", ("cycle of purchase", "term")),) and told.forbidden == ("see the file",) and told.sections == (("facts", ("Facts",)),)
    assert version == rules.checked(frame(GOOD))[1] != rules.checked(frame([*GOOD[:-1], ("sections", 0, "labels", "Other")]))[1]
    bad = [r for r in GOOD if r[0] != "trigger" and r[2] != "failure_code" and r[3] != "Facts"]
    bad += [("topics", 1, "topic_id", " cycle "), ("topics", 1, "presentation", "chart"), ("topics", 1, "failure_code", " "), ("topics", 1, "labels", None)]
    got = sorted((r["section"], r["entry"] if r["entry"] is not None else -1, r["field"], r["problem"]) for r in rules.violations(frame(bad)).collect())
    assert got == [
        ("sections", 0, "labels", "missing"), ("topics", 0, "failure_code", "missing"), ("topics", 1, "failure_code", "blank"), ("topics", 1, "failure_code", "missing"), ("topics", 1, "labels", "blank"),
        ("topics", 1, "presentation", "unknown_presentation"), ("topics", 1, "topic_id", "repeated"), ("trigger", -1, "", "missing_section"),
    ]
    with pytest.raises(ValueError, match=r"topics\[1\].topic_id: repeated"):
        rules.checked(frame(bad))


def test_parts_of_packs_keep_their_order(spark):
    rows = [("p", role, m, a, f, i, f"{role[0]}{m}.{a}.{f[0]}{i}") for role in ("auxiliary", "primary") for m in (1, 0) for a in (-1, 0, 1) for f in ("summary", "key_facts", "warnings", "usable_points") for i in (1, 0)] + [("p", "primary", 2, -1, "key_facts", 0, " ")]
    got = {(r["stage"], r["name"]): (r["texts"], r["from_materials"]) for r in packs.stage_lists(spark.createDataFrame(rows, "pack string, role string, material int, attachment int, field string, i int, text string").repartition(5)).collect()}
    assert got["primary_evidence", "key_facts"] == ([f"p{m}.-1.k{i}" for m in (0, 1) for i in (0, 1)], 2)
    assert got["attachment_evidence", "parsed_summaries"] == ([f"{r}{m}.{a}.s{i}" for r in "pa" for m in (0, 1) for a in (0, 1) for i in (0, 1)], 4)
    assert got["auxiliary_evidence", "comparison_points"][0] == [f"a{m}.-1.u{i}" for m in (0, 1) for i in (0, 1)]
    assert ("attachment_evidence", "table_summaries") not in got and got["attachment_evidence", "warnings"][1] == 4
