"""Packs below their limits, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions.text import truncate_head_tail
from evidra.operators import budgets, packs

SCHEMA = "pack string, role string, material int, attachment int, field string, i int, text string"


def slow_level(children, budget):
    """The largest level of (size, floor) within the budget, by trying them all."""
    taken = lambda level: sum(min(s, max(f, level)) for s, f in children)
    if taken(0) > budget:
        return None
    top = max(s for s, _ in children)
    return max(x for x in range(top + 1) if taken(x) <= budget)


@pytest.mark.parametrize("slots", [1, 3, 40])
def test_water_levels(spark, slots):
    rng = np.random.default_rng(2)
    children, wanted = [], []
    for g in range(12):
        mine = [(int(s), int(min(s, f))) for s, f in zip(rng.integers(0, 60, 9), rng.choice([0, 5, 30], 9), strict=True)]
        budget = int(rng.integers(0, 400)) if g else 0
        children += [(g, k, *c) for k, c in enumerate(mine)]
        wanted.append((g, budget, slow_level(mine, budget)))
    rows = spark.createDataFrame(children, "g int, k int, size long, floor long")
    given = spark.createDataFrame([(g, b) for g, b, _ in wanted], "g int, budget long")
    got = budgets.water_levels(rows, ["g"], "size", "floor", given, slots).collect()
    sizes = {g: [(s, f) for x, _, s, f in children if x == g] for g, _, _ in wanted}
    for r in got:
        level = dict((g, x) for g, _, x in wanted)[r["g"]]
        take = lambda x, g=r["g"]: [min(s, max(f, x or 0)) for s, f in sizes[g]]
        assert (r["level"] is None) == (level is None) and take(r["level"]) == take(level)


def slow_share(tree, budget):
    """A node's budget shared out to its children; leaves are (size, floor), inner nodes dicts."""
    size = lambda t: sum(map(size, t.values())) if isinstance(t, dict) else t[0]
    floor = lambda t: sum(map(floor, t.values())) if isinstance(t, dict) else t[1]
    level = slow_level([(size(c), floor(c)) for c in tree.values()], budget) or 0
    out = {}
    for k, c in tree.items():
        given = min(size(c), max(floor(c), level))
        out |= {(k, *x): n for x, n in slow_share(c, given).items()} if isinstance(c, dict) else {(k,): given}
    return out


def test_a_budget_goes_down_a_tree(spark):
    rng = np.random.default_rng(4)
    trees = {f"p{g}": {m: {a: {i: (int(n), int(min(n, rng.choice([0, 4, n])))) for i, n in enumerate(rng.integers(0, 40, int(rng.integers(1, 5))))} for a in range(int(rng.integers(1, 4)))} for m in range(3)} for g in range(6)}
    given = {f"p{g}": int(rng.integers(0, 300)) for g in range(6)}
    rows = [(p, m, a, i, *leaf) for p, t in trees.items() for m, x in t.items() for a, y in x.items() for i, leaf in y.items()]
    frame = spark.createDataFrame(rows, "pack string, material int, attachment int, i int, size long, floor long")
    told = packs.shared_out(frame, ("pack", "material", "attachment"), "size", "floor", spark.createDataFrame(list(given.items()), "pack string, budget long")).collect()
    assert {(r["pack"], r["material"], r["attachment"], r["i"]): r["left"] for r in told} == {(p, *k): n for p, t in trees.items() for k, n in slow_share(t, given[p]).items()}
    for p in trees:
        mine = [r for r in told if r["pack"] == p]
        assert sum(r["left"] for r in mine) <= max(given[p], sum(r["floor"] for r in mine))


def test_hard_limit(spark):
    """Below the ceiling to the character, protected texts whole; what can't fit is told."""
    rows = [("a", 0, k, 0, f"fact {k} 12345" if k % 3 == 0 else chr(97 + k) * (40 * k + 5)) for k in range(12)] + [("b", 0, 0, 0, "9" * 900), ("b", 1, 0, 0, "y" * 50), ("c", 0, 0, 0, "short"), ("c", 0, 0, 1, "")]
    frame = spark.createDataFrame(rows, "pack string, material int, attachment int, i int, text string")
    limits = spark.createDataFrame([("a", 700), ("b", 300), ("c", 100)], "pack string, budget long")
    fact = F.regexp_like("text", F.lit("[0-9]{3,}"))
    got = packs.hard_limit(frame, fact, 10, limits).collect()
    text = {k: [r for r in got if r["pack"] == k] for k in "abc"}
    assert 690 <= sum(len(r["text"]) for r in text["a"]) <= 700 and not any(r["over"] for r in text["a"])
    assert all(r["text"].startswith("fact") and r["whole"] for r in text["a"] if r["attachment"] % 3 == 0)
    assert all(" [...] " in r["text"] and len(r["text"]) == r["left"] for r in text["a"] if not r["whole"])
    assert all(r["over"] for r in text["b"]) and {len(r["text"]) for r in text["b"]} == {900, 10}
    assert {r["text"] for r in text["c"]} == {"short", ""} and all(r["whole"] for r in text["c"])


def test_profiles_of_materials(spark):
    own = [("summary", 0, "s" * 900), ("content_text", 0, "c" * 20_000), ("warnings", 0, "w" * 300), *(("policy_rules", i, f"r{i}" * 200) for i in range(9)), ("unknown", 3, "kept as it is")]
    rows = [(p, role, m, -1, *x) for p in ("safe", "table", "light", "full") for role, n in (("primary", 5), ("auxiliary", 12)) for m in range(n) for x in own]
    rows += [(p, "auxiliary", 0, a, f, i, "t" * 400) for p in ("safe", "light", "full") for a in range(6) for f in ("summary", "key_facts") for i in range(20 if f == "key_facts" else 1)]
    strategies = spark.createDataFrame([("safe", "safe_compact"), ("table", "table_heavy"), ("light", "light_compact"), ("full", "full_input")], "pack string, strategy string")
    got = packs.material_profiles(spark.createDataFrame(rows, SCHEMA), strategies)
    rows = got.collect()
    assert {(r["role"], r["material"]) for r in rows} == {("primary", m) for m in range(3)} | {("auxiliary", m) for m in range(10)}
    length = {(r["pack"], r["role"], r["field"]): len(r["text"]) for r in rows if r["attachment"] < 0 and r["field"] != "policy_rules"}
    mark = len(" [...] ")
    assert [length[p, "primary", "content_text"] - mark for p in ("safe", "table", "light")] == [12_000, 9_000, 5_200] and length["full", "primary", "content_text"] == 20_000
    assert [length[p, "auxiliary", "content_text"] - mark for p in ("safe", "table", "light")] == [600, 700, 900]
    assert length["light", "primary", "summary"] == 500 + mark and length["full", "primary", "summary"] == 900 and length["safe", "primary", "unknown"] == 13
    rules = [r for r in rows if r["pack"] == "safe" and r["role"] == "primary" and r["material"] == 0 and r["field"] == "policy_rules"]
    assert sorted(r["i"] for r in rules) == list(range(6)) and {len(r["text"]) for r in rules} == {300 + mark}
    files = {p: {r["attachment"] for r in rows if r["pack"] == p and r["attachment"] >= 0} for p in ("safe", "light", "full")}
    assert files == {"safe": {0, 1}, "light": {0, 1, 2, 3}, "full": set(range(6))}
    assert sum(r["field"] == "key_facts" for r in rows if r["pack"] == "light" and r["attachment"] == 0) == 16
    nested = {r["pack"]: r["materials"] for r in packs.folded(got).collect()}
    assert [(m["role"], m["material"]) for m in nested["light"]] == [("primary", m) for m in range(3)] + [("auxiliary", m) for m in range(10)]
    first = nested["light"][3]
    assert [a["attachment"] for a in first["attachments"]] == [0, 1, 2, 3] and [f["field"] for f in first["fields"]] == sorted(f["field"] for f in first["fields"])
    assert packs.folded(got.where("false")).count() == 0


def test_ladder_takes_the_first_profile_that_fits(spark):
    """A pack of long summaries fits with a common limit; one of many facts needs the strong profile; one of other texts never fits."""
    rows = [("a", "primary", 0, k, "summary", 0, "s" * 3000) for k in range(4)]
    rows += [("b", "primary", 0, 0, "key_facts", i, "f" * 100) for i in range(30)] + [("b", "primary", 0, 0, "summary", 0, "s" * 500)]
    rows += [("c", "primary", 0, -1, "content_text", 0, "c" * 9000), ("c", "primary", 0, 0, "summary", 0, "s" * 500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([("a", "light", 5000), ("b", "medium", 1100), ("c", "strong", 5000)], "pack string, tier string, target long")
    got = {r["pack"]: tuple(r)[1:] for r in packs.profile_ladder(frame, wanted).collect()}
    assert got == {"a": (1, "light_structure", 1250, 5000), "b": (2, "strong_structure", 500, 1100), "c": (None, None, None, None)}


def test_longest_summaries_go_first(spark):
    rows = [("a", "primary", 0, k, f, 0, f[0] * n) for k, (f, n) in enumerate([("summary", 3000), ("summary", 1500), ("summary", 200), ("key_facts", 4000)])]
    frame = spark.createDataFrame(rows, SCHEMA)
    over = spark.createDataFrame([("a", "light", 8700, 6300)], "pack string, tier string, total long, target long")
    got = packs.trimmed_summaries(frame, over, F.col("field") == "summary").collect()
    assert sorted((r["attachment"], r["chars"]) for r in got) == [(0, 1000), (1, 1100), (2, 200), (3, 4000)]


def test_limits_of_texts_by_row(spark):
    rows = spark.createDataFrame([("abcdefghij", n) for n in (0, 1, 4, 10, 20)], "s string, n int")
    got = [r[0] for r in rows.select(truncate_head_tail(F.col("s"), F.col("n"), "..")).collect()]
    assert got == ["..", "..j", "ab..ij", "abcdefghij", "abcdefghij"]
