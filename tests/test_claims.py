"""Claims against evidence: short claims, reverse containment, hard markers, terms."""

import pytest
from pyspark.sql import functions as F

from evidra.functions.text import collapse_space
from evidra.operators import claims, containment

CLAIMS = [
    (1, "two words"), (2, "ab"), (3, "本次采购周期为2年。"), (4, "a claim that holds brief evidence inside"), (5, " "), (6, "北京市医保局 发布 采购 通知"), (7, "企业 报价 须 明确"), (8, "企业 only one term"),
    (9, "采购金额 1000元 以内"), (10, "医疗机构 alone"), (11, "ＡＢＣ １２３ wide"), (12, "申报价格不超过100元"),
]
EVIDENCE = [
    (1, "xtwo wordsy"), (2, "cab"), (3, "采购周期为3年"), (4, "采购 周期 另定为 2 年"), (5, "holds brief evidence"), (6, "采购 通知: 北京市 医保局"), (7, "报价由企业负责"), (8, "报价 企业 价格 范围"),
    (9, "采购 100元"), (10, "各医疗机构执行"), (11, "see ABC123wide."), (12, "申报价格上限为1000元"), (13, "申报价格上限为100元"),
]


def score(claim, evidence):
    """The rule for one pair, on normalised texts."""
    import re
    import unicodedata

    def norm(x):
        return re.sub(r"\s+", "", unicodedata.normalize("NFKC", x)).strip("。！？!?；;，,：:|*-_`> ")

    def markers(x):
        x = unicodedata.normalize("NFKC", x)
        found = [norm(m[0]) for p in (claims.DATE, claims.VALUE) for m in re.finditer(p, x)]
        found += [r for r in claims.REGIONS if r in x] + [r + o for r in claims.REGIONS for o in claims.OFFICES if r + o in x] + [o for o in claims.OFFICES if o in x]
        return [m for m in found if m]

    c, e = norm(claim), norm(evidence)
    if not c or not e:
        return 0
    if c in e:
        return 100
    if len(e) <= 500 and e in c:
        return 95
    marks = markers(claim)
    if any(m not in e for m in marks):
        return 0
    shared = [t for t in claims.TERMS if t in c and t in e]
    if marks:
        return 80 + min(10, len(shared)) if shared else 0
    return 60 + min(20, 3 * len(shared)) if len(shared) >= 2 or any(len(t) >= 4 for t in shared) else 0


def shuffled(monkeypatch, spark):
    """No side is broadcast for the rest of the test."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(containment, "staged", lambda df, what, f=containment.staged: spark.conf.set(name, "-1") or f(df, what))


@pytest.fixture(autouse=True)
def broadcasts_again(spark):
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [True, False])
def test_claim_index_rules(spark, monkeypatch, few):
    """Against the rule applied to every pair, with broadcast and shuffled sides."""
    if not few:
        shuffled(monkeypatch, spark)
    left, right = spark.createDataFrame(CLAIMS, "c long, text string"), spark.createDataFrame(EVIDENCE, "e long, text string")
    found = {(r["claim"], r["evidence"]): r["score"] for r in claims.claim_index(left, right, "c", "e").collect()}
    every = {(a, b): score(x, y) for a, x in CLAIMS for b, y in EVIDENCE}
    best = {a: max(every[a, b] for b, _ in EVIDENCE) for a, _ in CLAIMS}
    assert found == {k: s for k, s in every.items() if s > 0 and (s == best[k[0]] or s >= 90)}
    assert found[3, 4] == 82 and (3, 3) not in found and found[7, 8] == 66 and (8, 7) not in found and found[10, 10] == 63 and found[11, 11] == 100 and found[12, 13] >= 80


def test_words_are_anchors(spark):
    """Claims of five words and more, inside longer words at both ends, and below five."""
    left = spark.createDataFrame([(1, "ne two three four fiv"), (2, "two three"), (3, "one two three four six")], "c long, text string")
    right = spark.createDataFrame([(1, "one two three  four five"), (2, "zq"), (3, None)], "e long, text string")
    got = claims.claim_index(left, right, "c", "e", normalise=collapse_space, terms=()).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 100), (2, 1, 100)]


def test_markers(spark):
    row = spark.createDataFrame([("２０２６年７月１日 北京市医保局 1,000元 15％ 2年",)], "s string").select(claims.hard_markers(F.col("s"))).first()[0]
    assert set(row) == {"2026年7月1日", "1日", "1,000元", "15%", "2年", "北京市", "北京市医保局", "医保局"}


def test_no_claims(spark):
    none = spark.createDataFrame([], "c long, text string")
    docs = spark.createDataFrame(EVIDENCE, "e long, text string")
    assert claims.claim_index(none, docs, "c", "e").count() == 0


def invented(rng, words, n):
    return " ".join(rng.choice(words, n))


@pytest.mark.parametrize("few", [True, False])
def test_phrases_of_all_kinds_are_found(spark, monkeypatch, few):
    """Whole words, ends and parts of words, signs, wide and odd spaces, short and repeated phrases: every pair as by looking."""
    import numpy as np

    if not few:
        shuffled(monkeypatch, spark)
    rng = np.random.default_rng(6)
    words = ["ab", "abc", "bca", "cab", "x", "采购周期为2年", "é中", "a.b*c", "100", "1000", "longerword"]
    texts = [(k, invented(rng, words, int(rng.integers(1, 14)))) for k in range(60)] + [(100, None), (101, ""), (102, " \n\t "), (103, "two\n\nlines  here"), (104, "采购 周期")]
    phrases = [(k, t[int(a) : int(a) + int(n)]) for k, (t, a, n) in enumerate((texts[int(i)][1], rng.integers(0, 12), rng.integers(1, 16)) for i in rng.integers(0, 60, 80))]
    phrases += [(200, "zz"), (201, " "), (202, ""), (203, None), (204, "o\n\nl"), (205, "2"), (206, "ab ab"), (206, "ab ab"), (207, "b  c"), (208, "购 周"), (209, "wor"), (210, " ab "), (211, "c x")]
    left, right = spark.createDataFrame(phrases, "claim long, text string"), spark.createDataFrame(texts, "evidence long, text string")
    got = sorted(map(tuple, claims.contained(left, right).collect()))
    assert got == sorted((c, e) for c, p in phrases for e, t in texts if p and p.strip() and t and p in t)
    assert claims.contained(left.where("false"), right).count() == 0 and claims.contained(left, right.where("false")).count() == 0


def test_a_phrase_meets_few_texts(spark):
    """Candidates are at most three times what is found, on the documents themselves."""
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select(F.col("doc_id").alias("evidence"), "text")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    parts = F.filter(F.transform(F.split("text", "[,;.]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 6)
    clauses = bench.select(F.explode(parts).alias("text")).distinct().select(F.xxhash64("text").alias("claim"), "text")
    index = containment.text_index(docs)
    pairs, found = containment.candidates(clauses, index).count(), containment.held(clauses, index).count()
    assert 0 < found <= pairs <= 3 * found
