"""What is kept of evidence, summaries of tables, projections of runs, notices on procedures: against values."""

from pyspark.sql import functions as F

from evidra.operators import evaluate, evidence, gates, grids, packs


def test_mandatory_items_that_are_gone(spark):
    before = spark.createDataFrame([("p", "a", True), ("p", "a", True), ("p", "b", True), ("p", "c", False), ("q", "d", False)], "g string, k string, mandatory boolean")
    after = spark.createDataFrame([("p", "a"), ("p", "c")], "g string, k string")
    assert sorted(map(tuple, evidence.missing_mandatory(before, after, "g", "k").collect())) == [("p", "b")]
    assert sorted(map(tuple, evidence.retention_status(before, after, "g", "k").collect())) == [("p", 2, 1, 1, 0.5, "measured"), ("q", 0, 0, 0, None, "not_applicable")]


def test_catalog_of_attachments(spark):
    rows = [("summary", 0, "short", "a"), ("summary", 0, "the longer one" * 20, "b"), ("key_facts", 1, "two", "a"), ("key_facts", 0, "one", "a"), ("key_facts", 0, "two", "b"), ("key_facts", 1, "three", "b"), ("key_facts", 2, " ", "b"), ("headers", 0, "Price", "b"), ("headers", 1, "Price", "b"), ("sections", 0, "x", "a")]
    frame = spark.createDataFrame([("p", "primary", 0, 0, f, i, t, s) for f, i, t, s in rows] + [("p", "primary", 0, -1, "summary", 0, "own", "a"), ("p", "primary", 0, 1, "headers", 0, "Only", "a")], "pack string, role string, material int, attachment int, field string, i int, text string, source string")
    got = {r["attachment"]: (r["summary"], r["key_facts"], r["table_headers"]) for r in packs.fidelity_catalog(frame, ("a", "b")).collect()}
    long = "the longer one" * 20
    assert got == {0: (f"{long[:104]} [...] {long[-56:]}", ["one", "two", "three"], ["Price"]), 1: ("", [], ["Only"])}


def test_summaries_of_tables(spark):
    cells = [("t", 0, 0, "price", "1,200.5 yuan"), ("t", 1, 0, "price", "none"), ("t", 2, 0, "price", "-3"), ("t", 0, 1, "name", "x"), ("t", 1, 1, "name", " x "), ("t", 2, 1, "name", None), ("t", 0, 2, "other", "y"), ("u", 0, 0, "other", "z")]
    cells += [("t", 10 + k, 0, "price", str(k)) for k in range(7)]
    out = {r["tab"]: r for r in grids.table_profiles(spark.createDataFrame(cells, "tab string, r int, p int, h string, v string").repartition(4), "tab", "r", "p", "h", "v", {"price": ("price",), "name": ("name",)}, ("price",)).collect()}
    name, price = out["t"]["profile"]
    assert (out["t"]["n_rows"], out["t"]["n_columns"], out["t"]["headers"]) == (10, 3, ["price", "name", "other"]) and out["u"]["profile"] is None
    assert (name["kind"], name["non_empty"], name["different"], name["samples"], name["numbers"]) == ("name", 2, 1, ["x"], [])
    assert (price["non_empty"], price["different"], price["least"], price["most"]) == (10, 10, -3.0, 1200.5)
    assert price["samples"] == ["1,200.5 yuan", "none", "-3", "0", "1"] and price["numbers"] == [1200.5, -3.0, 0.0, 1.0, 2.0]


def test_projection_of_runs(spark):
    rows = [(1, "deliverable", ["A"], "finished", "", 90), (2, "", None, "failed", None, None), (3, "", ["B", " "], "needs_manual_review", "TIMEOUT", None), (4, "failed", ["TIMEOUT"], "failed", "TIMEOUT", 7), (5, None, [], "running", "", None)]
    frame = spark.createDataFrame(rows, "run int, gate_status string, gate_codes array<string>, run_status string, error_code string, score int")
    assert sorted(map(tuple, evaluate.projected(frame, "run", ("score",)).collect())) == [
        (1, "deliverable", ["A"], 90), (2, "failed", ["RUN_FAILED", "DIAGNOSTICS_UNAVAILABLE"], None), (3, "needs_manual_review", ["B", "TIMEOUT"], 0), (4, "failed", ["TIMEOUT"], 7), (5, "", [], None),
    ]


def test_notices_on_procedures(spark):
    texts = [(1, "医用耗材挂网流程调整", 3), (2, "医用耗材采购", 3), (3, "流程调整", 3), (4, "申报挂网操作流程：影响分析与企业关注", 3), (5, "申报挂网操作流程：影响分析与企业关注", 2)]
    rows = spark.createDataFrame(texts, "k int, t string, n int").select("k", gates.process_notice(F.col("t")).alias("yes"), gates.process_depth(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r["yes"] for r in rows] == [True, False, False, True, True]
    assert rows[0]["x"]["missing"] == ["影响分析", "企业关注点"] and rows[0]["x"]["shallow"] and (rows[3]["x"]["missing"], rows[3]["x"]["shallow"]) == ([], False) and rows[4]["x"]["shallow"]


def test_closure_compares_only_what_a_round_found(spark, monkeypatch):
    """What was seen is read for the few items that were found again, and isn't shuffled: rounds of few items cost no more for many seen."""
    written = []
    real = evidence.staged
    monkeypatch.setattr(evidence, "staged", lambda df, name="t": written.append((name, df)) or real(df, name))
    start = spark.range(5000).selectExpr("concat('o', id) as item")
    links = start.selectExpr("item", "'s1' as source").union(start.selectExpr("item", "'s1' as source")).union(spark.createDataFrame([("s1", "n1"), ("n1", "s1"), ("n1", "o7")], "item string, source string"))
    got = [r[0] for r in evidence.closure(start, links).collect()]
    assert sorted(got) == sorted([f"o{i}" for i in range(5000)] + ["s1", "n1"])
    found = [df for name, df in written if name == "found"]
    assert [df.count() for df in found] == [1, 1, 2] and [df.count() for name, df in written if name == "reached"] == [5000, 1, 1, 0]
