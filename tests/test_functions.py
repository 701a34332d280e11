import pytest
from pyspark.sql import functions as F

from evidra.functions import scalars, text
from evidra.operators import claims, evidence, tables
from evidra.streaming import fold
from tests.conftest import DATA


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_compression_tiers_at_their_boundaries(spark):
    n = [79_999, 80_000, 80_001, 90_000, 90_001, 150_000, 150_001, 252_822]
    got = values(spark, [(x,) for x in n], "n long", t=scalars.compression_tier(F.col("n")), w=scalars.tier_window(F.col("n")))
    assert [t for t, _ in got] == ["none", "none", "light", "light", "medium", "medium", "strong", "strong"]
    assert [tuple(w) for _, w in got] == [(79_999, 79_999), (80_000, 80_000), (78000, 79500), (78000, 79500), (70000, 79000), (70000, 79000), (75000, 79000), (75000, 79000)]
    small = values(spark, [(10,), (1_500,), (11_500,), (200_000,)], "n long", t=scalars.compression_tier(F.col("n"), 1_200), w=scalars.tier_window(F.col("n"), 1_200))
    assert [(t, *w) for t, w in small] == [("none", 10, 10), ("light", 1_000, 1_000), ("medium", 1_000, 1_000), ("strong", 1_000, 1_000)]


def test_input_strategy_rules_in_order(spark):
    rows = [(2, True, True, 1), (1, True, True, 1), (1, False, True, 99_999), (1, False, False, 65_000), (1, False, False, 65_001), (0, False, False, 75_001), (1, False, False, 80_001)]
    strategy = scalars.input_strategy(F.col("p"), F.col("a"), F.col("t"), F.col("n"))
    got = values(spark, rows, "p int, a boolean, t boolean, n int", s=strategy, k=scalars.strategy_type(strategy))
    assert got == [
        ("staged_generation", "complexity_based"), ("attachment_led", "structure_based"), ("table_heavy", "structure_based"), ("full_input", "size_based"),
        ("light_compact", "size_based"), ("safe_compact", "size_based"), ("staged_generation", "complexity_based"),
    ]


def test_dates_and_durations(spark):
    got = values(spark, [("2024年2月30日",), ("2024年2月9日",), ("none",), ("am 2026-7-1 und 2025.1.2",), ("1999-01-01",)], "s string", d=scalars.normal_date(F.col("s")))
    assert [d for (d,) in got] == [None, "2024-02-09", None, "2026-07-01", None]
    all_dates = values(spark, [("2024年2月9日 2024-3-1 2025 年 1 月 2 日",)], "s string", d=scalars.dates(F.col("s")))
    assert all_dates == [(["2024年2月9日", "2024-3-1", "2024年2月9日", "2025 年 1 月 2 日"],)]
    times = values(spark, [("2026-07-14T08:00:00+08:00",), ("2026-07-14 08:00:00",), ("2026-07-14T08:00:00Z",), ("x",), (None,)], "s string", t=scalars.iso_timestamp(F.col("s")).cast("string"))
    assert [t for (t,) in times] == ["2026-07-14 00:00:00", "2026-07-14 08:00:00", "2026-07-14 08:00:00", None, None]
    said = [("10年",), ("2 years",), ("1.50 months",), ("30天",), ("soon",)]
    assert [x for (x,) in values(spark, said, "s string", d=scalars.normal_duration(F.col("s")))] == ["P10Y", "P2Y", "P1.5M", "P30D", None]
    old = [("10年",), ("10.0年",), ("2.50个月",), ("100日",)]
    assert [x for (x,) in values(spark, old, "s string", d=scalars.normal_duration(F.col("s"), legacy=True))] == ["P1Y", "P10Y", "P2.5M", "P1D"]
    assert [x for (x,) in values(spark, old, "s string", d=scalars.normal_duration(F.col("s")))] == ["P10Y", "P10Y", "P2.5M", "P100D"]


def test_numbers_levels_and_progress(spark):
    assert values(spark, [("about 1,234.5 and 6",), ("",)], "s string", n=scalars.first_number(F.col("s"))) == [(1234.5,), (None,)]
    level = scalars.evidence_level(F.col("n"))
    got = values(spark, [(999,), (1000,), (4999,), (5000,), (11_999,), (12_000,)], "n int", l=level, r=scalars.report_length(level))
    assert [x for x, _ in got] == ["low", "medium", "medium", "high", "high", "very_high"] and got[0][1] == "600-1000"
    rows = [(True, 1.0), (False, 0.0), (False, 2.5), (False, 5.0), (False, 12.0), (False, 20.0), (False, 40.0), (False, 60.0), (False, 120.0), (False, 9999.0), (False, -3.0), (False, None)]
    assert [x for (x,) in values(spark, rows, "t boolean, e double", p=scalars.progress_percent(F.col("t"), F.col("e")))] == [100, 35, 40, 45, 54, 65, 73, 82, 86, 90, 35, 35]


def test_numbers_in_tables(spark):
    said = [("价格 1,000元 和 15.0", "15"), ("115", "15"), ("15.5", "15"), ("1000", "1,000"), ("x15y", "15"), ("1", "")]
    assert [x for (x,) in values(spark, said, "l string, n string", y=scalars.has_number(F.col("l"), F.col("n")))] == [True, False, False, True, True, False]
    forms = [("1,200.5元", "单位：元"), ("3万元 和 3元", "(元)"), ("5元", "无"), ("5", "（元）")]
    assert [x for (x,) in values(spark, forms, "m string, c string", f=scalars.money_forms(F.col("m"), F.col("c")))] == [["1200.5"], ["3"], [], []]
    score = scalars.acceptance_score(F.col("a"), F.col("d"))
    assert [x for (x,) in values(spark, [("字" * 1200, True), ("字 " * 1199, True), (None, None), ("报告解析失败 质检状态：needs_fix", False)], "a string, d boolean", s=score)] == [100, 85, 60, 15]
    flags = scalars.table_score(F.col("f"), F.col("n"), F.col("r"), F.col("h"))
    assert [x for (x,) in values(spark, [(8, 9, 6000, True), (0, 0, 1, False), (2, 3, 10, False)], "f int, n int, r int, h boolean", s=flags)] == [100, 0, 34]


def test_text(spark):
    page = "<title>x</title><script>var t='</p>'</script><p>a &amp; b</p>"
    assert values(spark, [(page,), (None,)], "s string", t=text.html_text(F.col("s"))) == [("x a & b",), (None,)]
    assert values(spark, [("abcdefghij" * 3,)], "s string", t=text.truncate_head_tail(F.col("s"), 10, "~")) == [("abcdef~ghij",)]


def test_closure_is_transitive_and_handles_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "item string, source string")
    got = evidence.closure(spark.createDataFrame([("a",)], "item string"), links)
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c"]


def test_conflicts_and_duplicates(spark):
    facts = spark.createDataFrame([("k", "1"), ("k", "1"), ("m", "1"), ("m", "2")], "key string, value string")
    got = {r["key"]: (r["conflict"], r["kept_value"]) for r in evidence.conflicts(facts, ["key"], "value").collect()}
    assert got == {"k": (False, "1"), "m": (True, None)}


def test_support_rate_without_claims_is_one(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = claims.support(none, claims.claim_index(none, docs, "item_id", "doc_id"), "item_id").first()
    assert (row["claims"], row["support_rate"]) == (0, 1.0)


def test_spread_takes_halves_to_even(spark):
    rows = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert sorted(r["i"] for r in tables.spread(rows, "g", "i", 3).collect()) == [0, 4, 9]


def test_weights(spark):
    parts = [F.col("n")] * 9
    assert values(spark, [(1,), (10,), (None,)], "n int", w=scalars.weighted_chars(parts)) == [(4,), (49,), (0,)]


def test_last_values_of_any_cut(spark):
    from evidra.operators import budgets

    rows = spark.range(400).selectExpr("id % 2 g", "id % 50 r", "id k", "if(id % 7 = 0, id, null) x")
    for slots in (1, 3, 64):
        got = budgets.carried(rows, "g", "r", ["k"], F.col("x"), "c", slots=slots).collect()
        top = budgets.carried(rows, "g", "r", ["k"], F.col("x"), "c", slots=slots, same_rank=True).collect()
        for g in (0, 1):
            last = None
            for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["r"], r["k"])):
                last = r["x"] if r["x"] is not None else last
                assert r["c"] == last
            mine = [r for r in top if r["g"] == g]
            assert all(r["c"] == max((o["x"] for o in mine if o["r"] <= r["r"] and o["x"] is not None), default=None) for r in mine)


def test_repeated_events_of_a_stream_are_one(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(50).withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionByName(events).repartition(1).write.parquet(str(tmp_path / "in"))
    run = fold.distinct_events(fold.stream_table(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("once").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("once").count() == 50


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = fold.windowed_counts(fold.stream_table(spark, str(tmp_path / "in"), events.schema))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("folded").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, fold.windowed_counts(events).collect()))


@pytest.mark.parametrize("most, slots", [(100_000, None), (40, 5), (1, None)])
def test_nearest_ranks_of_any_size(spark, most, slots):
    """Ties, repeated values, nulls, negative numbers, one value, a group without any: brackets of any width give the same."""
    import math

    import numpy as np

    from evidra.operators import selection

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(0, 1e6, 700).tolist(), "b": rng.integers(0, 4, 500).astype(float).tolist(), "c": [5.5], "d": [7.0] * 300, "e": [None] * 5, "f": [-1e300, 0.0, 1e-300, 1e300, None]}
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(5)
    points = (0.01, 0.5, 0.95, 1.0)
    got = {(r["g"], r["p"]): r["found"] for r in selection.nearest_ranks(rows, ["g"], "v", points, most, slots).collect()}
    wanted = {}
    for g, values in groups.items():
        own = sorted(v for v in values if v is not None)
        wanted |= {(g, p): own[max(1, math.ceil(round(p * len(own), 6))) - 1] for p in points if own}
    assert got == wanted


def test_ranks_over_ranges(spark):
    from evidra.operators import selection

    rows = spark.createDataFrame([("x" if k % 3 else None, k % 7, k) for k in range(200)], "g string, o int, k int").repartition(6)
    got = selection.ranked(rows, ["g"], [-F.col("o")], "r").collect()
    for g in ("x", None):
        mine = sorted((r["r"], -r["o"]) for r in got if r["g"] == g)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and [o for _, o in mine] == sorted(o for _, o in mine)


def test_cell_budgets_of_any_cut(spark):
    """Anchors, then first cells, then others, each evenly spread: against a plain loop, whole groups and cut ones."""
    from evidra.operators import grids

    rows = [("g", k, f"t{k // 9}" if k % 5 else None, k % 4 == 1) for k in range(60)] + [("h", k, f"t{k}", False) for k in range(30)] + [("i", k, "t", True) for k in range(5)]
    frame = spark.createDataFrame(rows, "g string, k int, t string, f boolean").repartition(4)

    def slow(mine, limit):
        first = {}
        for k, t, _ in mine:
            first.setdefault(t, k)
        left, out = limit, {}
        for tier, holds in enumerate((lambda k, t, f: k in (mine[0][0], mine[-1][0], first[t]), lambda k, t, f: f, lambda k, t, f: True)):
            own = [k for k, t, f in mine if k not in out and holds(k, t, f)]
            take = min(left, len(own))
            places = range(len(own)) if len(own) <= take else {round(i * (len(own) - 1) / max(take - 1, 1)) for i in range(take)}
            out |= {own[i]: tier for i in places}
            left -= take
        return out if len(mine) > limit else {k: out.get(k) for k, _, _ in mine}

    for limit, slots in ((8, None), (20, 4), (45, 1), (1, 3)):
        got = {}
        for r in grids.cell_budget(frame, "g", "k", "t", F.col("f"), limit, slots).collect():
            got.setdefault(r["g"], {})[r["k"]] = r["tier"]
        assert got == {g: slow([(k, t, f) for x, k, t, f in rows if x == g], limit) for g in "ghi"}
