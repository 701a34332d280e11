"""Reports, claims, facts and gates on the notices that they are made for."""

import pytest
from pyspark.sql import functions as F

from evidra.functions import text
from evidra.operators import claims, documents, evidence, facts, gates, grids, markdown, pages, predicates, runs

REPORT = """# 关于耗材集中带量采购的公告

本次采购周期为2年。其他规则按公告执行；短。

```
采购周期为9年，不是结论。
```

## 报价

| 产品 | 价格 |
|---|:--:|
| 支架Ａ | 1000元 |
| 球囊 | |

- 企业应在2026年7月1日前申报
本次采购周期为2年。
"""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_claims_of_a_report(spark):
    told = markdown.lines(frame(spark, [(1, REPORT), (2, None), (3, "| no header | x企业 |\n\n| 中选 |")], "k int, m string"), "k", "m")
    got = {(r["k"], r["location"]): (r["claim"], r["locations"]) for r in markdown.claims_of(told, "k").collect()}
    assert got == {
        (1, "line[2].sentence[0]"): ("本次采购周期为2年", "line[2].sentence[0],line[16].sentence[0]"),
        (1, "line[2].sentence[1]"): ("其他规则按公告执行", "line[2].sentence[1]"),
        (1, "table[0].row[0]"): ("产品: 支架Ａ | 价格: 1000元", "table[0].row[0]"),
        (1, "line[15].sentence[0]"): ("企业应在2026年7月1日前申报", "line[15].sentence[0]"),
        (3, "table[0].row[0]"): ("no header | x企业", "table[0].row[0]"),
        (3, "table[0].row[1]"): ("中选", "table[0].row[1]"),
    }


def test_width_and_space_make_no_other_claim(spark):
    rows = [(1, "采购周期 为２年。"), (2, "采购周期为2年"), (3, "采购周期为20年")]
    told = markdown.lines(frame(spark, rows, "k int, m string"), "k", "m")
    ids = {r["k"]: r["claim_id"] for r in markdown.claims_of(told, "k").collect()}
    assert ids[1] == ids[2] != ids[3]


def test_parts_and_structure(spark):
    rows = [(1, REPORT), (2, "a\nb\nc\nd\ne"), (3, ""), (4, "# 标题很短吗\n我认为 {{x}}\n## s\n| a | |\n|---|---|\n| 1 |")]
    parts = markdown.parts_of(markdown.lines(frame(spark, rows, "k int, m string"), "k", "m"), "k")
    got = {k: [(r["part"], r["text"]) for r in sorted(parts.where(f"k = {k}").collect(), key=lambda r: r["place"])] for k in (1, 2)}
    assert got[1][:4] == [("title", "关于耗材集中带量采购的公告"), ("lead", "本次采购周期为2年。其他规则按公告执行；短。"), ("section", "报价"), ("table", "产品 | 价格")]
    assert [p for p, _ in got[2]] == ["lead"] * 4 + ["paragraph"]
    issues = {(r["k"], r["issue"]) for r in markdown.structural_issues(parts, "k").collect()}
    assert issues == {(2, "no_title"), (2, "no_sections"), (4, "no_title"), (4, "informal_words"), (4, "crooked_table"), (4, "empty_header")}
    metrics = {r["k"]: tuple(r)[1:] for r in markdown.report_metrics(parts, "k").collect()}
    assert metrics[1] == (1, 1, 1, 2) and metrics[2][0] == 4


def test_facts_of_notices(spark):
    rows = [
        ("n1", 1, "本次采购周期为2年。其他规则按公告执行。"), ("n1", 2, "采购周期：２ 年"), ("n2", 3, "采购周期为1年。"), ("n2", 4, "采购周期为10年；"), ("n3", 5, "采购周期详见采购文件。报价要求：不超过100元"), ("n3", 6, "报价要求：不超过100元。"),
        ("n3", 7, "采购周期另行通知"), ("n4", 8, None),
    ]
    got = {(r["n"], r["fact_type"]): (r["candidates"], r["conflict"], r["i"], r["value"]) for r in facts.topic_facts(frame(spark, rows, "n string, i int, t string"), "n", "i", "t", facts.PROCUREMENT).collect()}
    assert got == {
        ("n1", "procurement_cycle"): (2, False, 1, "本次采购周期为2年"),
        ("n2", "procurement_cycle"): (2, True, None, None),
        ("n3", "quote_rules"): (2, False, 5, "报价要求:不超过100元"),
    }


def test_rules_are_checked():
    for bad in ({"topics": (("a", ("x",)), ("a", ("y",)))}, {"topics": (("a", ()),)}, {"topics": (("a", (" ",)),)}, {"topics": (("a", ("x",)),), "required": ("b",)}):
        with pytest.raises(ValueError):
            facts.Rules(**bad)


def test_applicability(spark):
    yes = predicates.applicable(F.col("m"), F.col("c"), F.col("t"), F.col("g"), ["项目公告"], ["project_notice"], ["带量采购", "采购文件"], ["集采"])
    rows = [("项目公告", "x", "集中带量采购", None), ("其他", "project_notice", None, "耗材集采"), ("其他", "x", "带量采购", "集采"), ("项目公告", "x", "通知", "药品")]
    assert [r[0] for r in frame(spark, rows, "m string, c string, t string, g string").select(yes).collect()] == [True, True, False, False]


def test_domain_gate_orders_its_codes(spark):
    rules = facts.Rules(topics=(("a", ("xa",)), ("b", ("xb",))), required=("a", "b"))
    reports = frame(spark, [(1, "says xa and xb", 0), (2, "says xb", 1), (3, "nothing", 0), (4, "nothing", 0)], "k int, r string, u int")
    held = frame(spark, [(1, "a", False), (1, "b", False), (2, "a", False), (3, "b", True)], "k int, fact_type string, conflict boolean")
    got = {r["k"]: (r["status"], r["primary_code"], r["codes"], r["missing_topics"]) for r in gates.domain_gate(reports.withColumn("t", gates.named_topics(F.col("r"), rules)), "k", "t", "u", held, rules).collect()}
    assert got == {1: ("passed", "", "", ""), 2: ("blocked", "unsupported_claim", "unsupported_claim,topic_missing", "a"), 3: ("blocked", "rule_conflict", "rule_conflict,topic_missing", "b"), 4: ("passed", "", "", "")}


def test_gate_chain_fails_closed(spark):
    reports = frame(spark, [(1, "ok"), (2, "bad"), (3, "ok")], "k int, t string")
    has = lambda word: lambda r: r.select("k", F.contains("t", F.lit(word)).alias("passed"))
    knows = lambda r: r.where("k <> 3").select("k", F.lit(True).alias("passed"))
    got = {r["k"]: (r["passed"], r["failed_gates"]) for r in gates.chain(reports, [("body", has("ok")), ("index", knows)], "k").collect()}
    assert got == {1: (True, ""), 2: (False, "body"), 3: (False, "index")}


@pytest.mark.parametrize(
    "raw, wanted",
    [('{"a": 1}', '{"a": 1}'), ('x {"a": "}"} y {"b": 2}', '{"a": "}"}'), ("<think>{\"n\": 1}</think>```json\n{\"a\": {\"b\": 2}}\n```", '{"a": {"b": 2}}'), ("{open", ""), ("{not json} {\"a\": 1}", '{"a": 1}'), (None, ""), ("none", "")],
)
def test_first_object(raw, wanted):
    assert gates.first_object(raw) == wanted


def test_checks_of_a_model(spark):
    rows = [(1, '{"status": "pass"}'), (2, '{"status": "Needs-Fix"}'), (3, '{"unsupported_claims": ["x"]}'), (4, '{"unsupported_claims": [{"severity": "Minor", "claim": "x"}], "issues": "one"}'), (5, "no object"), (6, '{"history_leakage": {"severity": "严重"}}')]
    got = {r["k"]: tuple(r)[1:] for r in gates.qa_result(frame(spark, rows, "k int, raw string"), "k", "raw", ("major", "严重")).collect()}
    assert got == {1: ("pass", 0, False), 2: ("needs_fix", 0, True), 3: ("pass", 1, True), 4: ("pass", 2, False), 5: ("unreadable", 0, True), 6: ("pass", 1, True)}


def test_repair_narrows_or_deletes(spark):
    left = frame(spark, [(1, "采购周期为二年整，价格上限为一百元整"), (2, "完全没有依据的说法"), (3, "报价要求不超过一百元")], "c int, text string")
    right = frame(spark, [(1, "本次采购周期为二年整。"), (2, "报价要求不超过一百元。")], "e int, text string")
    got = {r["c"]: (r["action"], r["repaired"]) for r in gates.narrowed(left, right, "c", "e", "text").collect()}
    assert got == {1: ("narrowed", "采购周期为二年整"), 2: ("deleted", ""), 3: ("kept", "报价要求不超过一百元")}
    fresh = gates.new_facts(frame(spark, [(1, "a 10%")], "k int, text string"), frame(spark, [(1, "a 10% and 20%")], "k int, text string"), "k", "[0-9]+%")
    assert [tuple(r) for r in fresh.collect()] == [(1, "20%")]


def test_headers_and_kinds_of_columns(spark):
    rows = [("t", 0, ["2026年公告", "", ""]), ("t", 1, ["企业名称", "产品名称", "中选价"]), ("t", 2, ["甲公司", "支架", "100"]), ("u", 0, ["a", "b"]), ("u", 1, ["c", "d"]), ("v", 30, ["企业名称"])]
    got = {r["g"]: (r["header_row"], r["score"]) for r in grids.headers(frame(spark, rows, "g string, r int, c array<string>"), "g", "r", "c").collect()}
    assert got["t"][0] == 1 and got["u"][0] == 0 and "v" not in got
    kinds = frame(spark, [("中选价格",), ("Supplier Name",), ("备注",)], "h string").select(grids.kinds_of(F.col("h"))).collect()
    assert [r[0] for r in kinds] == [["price", "selected_status"], ["enterprise"], []]
    fit = frame(spark, [([" a ", None],), (["a", "b", "c", "", "d"],), ([],)], "c array<string>").select(grids.fitted(F.col("c"), 3)).collect()
    assert [r[0] for r in fit] == [["a", "", ""], ["a", "b", "c；d"], ["", "", ""]]


def test_cross_support(spark):
    a, b = frame(spark, [(1, "A", "x"), (2, "B", None), (3, "A", "y")], "k int, level string, v string"), frame(spark, [(1, "A", "x"), (2, "B", None), (3, "A", "z"), (4, "C", "n")], "k int, level string, v string")
    assert {r["k"]: r["state"] for r in facts.cross_supported(a, b, "k", ["level", "v"]).collect()} == {1: "supported", 2: "supported", 3: "changed", 4: "added"}


def test_text_helpers(spark):
    one = lambda c, s: frame(spark, [(s,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(text.answer_text, "<think>a</think>\n```md\n# T\nx\n```") == "# T\nx" and one(text.answer_text, "好的，以下是报告：\n正文") == "正文" and one(text.answer_text, "ok <think>open") == "ok"
    assert one(text.reader_words, "# 标题\n**中文** and two-words `x` <b>y</b> [link](http://a.b)") == 9
    assert one(text.nfkc, "①ﬁ２") == "1fi2" and one(text.fold_width, "（Ａ）　x") == "(A) x"
    assert one(text.file_name, " a/b:c?.. ") == "a_b_c" and one(text.file_name, "///") == "report"
    assert one(text.clean_paragraphs, "a\u00a0 b \n\n\n\n c\r\n") == "a b\n\nc"
    assert one(text.inline_text, "## {{x}}**b** [t](u) <i>y</i>") == "b t y"
    assert one(predicates.cut_off, "完整的句子。") is False and one(predicates.cut_off, "没有结") is True and one(predicates.title_like, "关于采购的公告") is True and one(predicates.title_like, "- 列表") is False
    assert evidence.item_id and claims.TERMS


def test_links_and_main_text(spark):
    html = '''<body><h1> </h1><title>T</title><div class="x TRS_Editor">short</div><article>%s</article><a href="#x">附件</a><a href="a/b.PDF">one</a><a href="/down?f=x.xlsx">下载</a><a href="/down">下载</a>
<a href="//h.cn/list">价格<b>清单</b></a><a href="a/b.PDF">again</a><a href="mailto:x">附件</a></body>''' % ("正文" * 50)
    rows = frame(spark, [(1, "https://www.a.cn/x/y.html?q=1", html), (2, "http://b.cn", "no tags")], "k int, u string, h string")
    got = {(r["k"], r["place"]): (r["link"], r["said"]) for r in pages.file_links(rows, "k", "u", "h").collect()}
    assert got == {(1, 1): ("https://www.a.cn/x/a/b.PDF", "one"), (1, 2): ("https://www.a.cn/down?f=x.xlsx", "下载"), (1, 3): ("https://h.cn/list", "价格 清单")}
    told = {r["k"]: (r["t"], r["m"]) for r in rows.select("k", pages.page_title(F.col("h")).alias("t"), pages.main_text(F.col("h")).alias("m")).collect()}
    assert told == {1: ("T", "正文" * 50), 2: ("", "no tags")}


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ('{"data": {"status": "succeeded", "id": "w1", "outputs": {"text": "```json\\n{\\"report_markdown\\": \\"# A\\"}\\n```"}}}', ("w1", "# A", "")), ('{"workflow_run_id": "w", "data": {"outputs": {"result": "# plain"}}}', ("w", "# plain", "")),
        ('{"data": {"outputs": {"text": "x"}}}', ("", "", "workflow_id_missing")), ('{"data": {"id": "w", "status": "Stopped"}}', ("", "", "workflow_failed")), ('{"data": {"id": "w", "outputs": {}}}', ("w", "", "output_empty")),
        ('{"data": {"id": "w", "finish_reason": "length", "outputs": {"report_markdown": "# A"}}}', ("w", "# A", "output_truncated")), ("[1]", ("", "", "output_schema_invalid")), ("", ("", "", "output_schema_invalid")),
    ],
)
def test_answers_of_providers(spark, raw, wanted):
    assert tuple(documents.unwrapped(frame(spark, [(1, raw)], "k int, r string"), "k", "r").first())[1:] == wanted


def test_reports_in_json():
    assert documents.repaired_json('x {"a": "say "hi", now", "b": ["c"]} y') == {"a": 'say "hi", now', "b": ["c"]} or documents.repaired_json('x {"a": "say "hi" now", "b": ["c"]} y') == {"a": 'say "hi" now', "b": ["c"]}
    assert documents.repaired_json("no") is None and documents.repaired_json("{") is None
    assert documents.walk({"t": " a  b ", "Thinking": "x", "s": [{"p": ["c", None]}]}) == [("t", "a b"), ("s[0].p[0]", "c")]
    assert documents.strings_in({"b": [1, {"z": "y", "a": " "}], "a": None}) == ["1", "y"]


def test_open_external_steps_block_a_resume(spark):
    steps = ("prepare", "compact", "provider", "export")
    rows = [(1, "prepare", "completed", 1), (1, "provider", "started", 2), (2, "prepare", "completed", 1), (2, "provider", "started", 2), (2, "provider", "completed", 3), (3, "prepare", "started", 1), (4, "compact", "completed", 1), (4, "compact", "failed", 2)]
    got = {r["r"]: (r["blocked"], r["resumed_from"], r["next_step"], r["skipped"]) for r in runs.checkpoint_plan(frame(spark, rows, "r int, s string, st string, n int"), "r", "s", F.col("st"), ["n"], steps, "provider").collect()}
    assert got == {1: (True, "prepare", "", "prepare"), 2: (False, "provider", "compact", "prepare,provider"), 3: (False, "", "prepare", ""), 4: (False, "", "prepare", "")}


def test_sections_of_a_report(spark):
    headings = frame(spark, [(["公告要点", "核心规则", "时间节点与步骤"],), ([],)], "h array<string>").select(gates.missing_sections(F.col("h"), facts.PROCUREMENT)).collect()
    assert [r[0] for r in headings] == [["impact_and_risk", "recommendations"], ["overview", "core_rules", "actions", "impact_and_risk", "recommendations"]]
    reports = frame(spark, [(1, 0, ["x"], False), (2, 0, ["公告要点"], True)], "k int, u int, h array<string>, c boolean")
    rules = facts.Rules(topics=(("a", ("xa",)),), sections=(("overview", ("公告要点",)),))
    none = frame(spark, [], "k int, fact_type string, conflict boolean")
    got = gates.domain_gate(reports.withColumn("t", F.array().cast("array<string>")), "k", "t", "u", none, rules, "h", {"c_level_used": F.col("c")}).collect()
    assert {r["k"]: r["codes"] for r in got} == {1: "section_missing", 2: "c_level_used"}


def test_calculated_percentages_need_no_evidence(spark):
    rows = [(1, "# t\n## s\n按表内数据测算。\n| 企业 | 占比 |\n|---|---|\n| 甲 | 15% |"), (2, "# t\n## s\n| 企业 | 占比 |\n|---|---|\n| 甲 | 15% |")]
    parts = markdown.parts_of(markdown.lines(frame(spark, rows, "k int, m string"), "k", "m"), "k")
    nothing = frame(spark, [(1, "x"), (2, "x")], "k int, line string")
    assert [r["k"] for r in markdown.cells_without_evidence(parts, "k", nothing, "[0-9]+%").collect()] == [2]


def test_sections_and_glossaries(spark):
    one = lambda c, s: frame(spark, [(s,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(lambda c: text.without_sections(c, ["材料说明", "附件说明"]), "# T\na\n## 材料说明\nb\n### c\nd\n## 附件说明（1）\ne") == "# T\na\n### c\nd"
    assert one(text.glossary_entries, "- **中选价**：合同价\n2. 集采 —— 集中采购；无\n中选价: 合同价") == ["中选价: 合同价", "集采: 集中采购"]


def test_only_a_first_line_is_a_preamble(spark):
    raws = ["Sure, here is the report:\nbody", "Certainly!\nbody", "a\nHere is. More of it.\nb", "Here is. And more.\nb", "a\nSure: no\n以下是价格\nb", "Surely this:\nb", "```md\nHere is it:\n\n# T\n```", "好的。"]
    got = [r[0] for r in frame(spark, [(i, s) for i, s in enumerate(raws)], "i int, s string").orderBy("i").select(text.answer_text(F.col("s"))).collect()]
    assert got == ["body", "body", "a\nHere is. More of it.\nb", "Here is. And more.\nb", "a\nSure: no\n以下是价格\nb", "Surely this:\nb", "# T", ""]


def test_reports_are_dealt_by_the_size_of_their_texts(spark, monkeypatch):
    """Partitions grow in number with the texts, not in size, and the lines of a report are sorted once."""
    monkeypatch.setattr(markdown, "PARTITION_CHARS", 1000, raising=False)
    rows = frame(spark, [(i, REPORT) for i in range(200)], "k int, m string")
    told = markdown.lines(rows, "k", "m")
    assert told._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert told.rdd.getNumPartitions() >= 200 * len(REPORT) // 1000
    assert markdown.claims_of(told, "k").groupBy("k").count().where("count <> 4").count() == 0


def test_a_report_is_checked_in_one_pass(spark):
    rows = [(1, "# A title of a report\n## s\n| a | b |\n|---|---|\n| 1 |\n| 1 | 2 |\n| 3 |\ntext\n| c | |\n|---|---|\n| 1 |\n| 1 | 2 |")]
    found = markdown.structural_issues(markdown.parts_of(markdown.lines(frame(spark, rows, "k int, m string"), "k", "m"), "k"), "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "crooked_table", "rows 3"), (1, "empty_header", "tables 1")]
