"""Manifest, filter audit and decontamination against plain loops, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.llm import decontaminate, filter_audit, merkle

# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(level, fanout):
    """All levels of the tree over some nodes."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def up(levels, k, own, fanout):
    """(siblings, root) of the walk of node k, with another hash, to the top."""
    siblings = []
    for level in levels[:-1]:
        run = k // fanout * fanout
        before, after = level[run:k], level[k + 1 : run + fanout]
        siblings += before + after
        own, k = h(*before, own, *after), k // fanout
    return siblings, own


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def slow_manifest(rows, fanout=2):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        changed = r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        leaf = lambda n, r=r: h(*map(value, (*r[:3], n, r[4])))
        groups.setdefault(r[2], []).append((r[0], leaf(r[3]), leaf(r[3] + 1 if changed else r[3])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g, x in groups.items()}
    trees = {g: tree([leaf for _, leaf, _ in own[g]], fanout) for g in order}
    top = tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        rest = up(top, k, trees[g][-1][0], fanout)[0]
        for i, (doc_id, leaf, changed) in enumerate(own[g]):
            siblings, subroot = up(trees[g], i, changed, fanout)
            root = up(top, k, subroot, fanout)[1]
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*siblings, *rest), root, root == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i) if i % 11 else None, ["a", None, ""][i % 3], g, None if i % 5 == 0 else int(rng.integers(0, 99)), ["", None, "täxt 中", "x" * 50][i % 4]) for g, n in sizes.items() for i in rng.permutation(n)]
    return rows + rows[:2]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes, parts", [({"en": 37, None: 1, "": 8, "é": 5, "zz": 2}, 3), ({"en": 130}, 7), ({"a": 1}, 2), ({f"g{i}": i % 3 + 1 for i in range(9)}, 4)])
def test_manifest(spark, sizes, parts):
    rows = manifest_rows(sizes)
    got = merkle.verify_documents(spark.createDataFrame(rows, COLUMNS).repartition(parts))
    assert sorted(map(tuple, got.collect()), key=str) == slow_manifest(rows)
    if sizes == {"a": 1}:
        assert merkle.verify_documents(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("fanout, block", [(2, 4), (3, 9), (5, 1)])
def test_other_fanouts_and_blocks(spark, fanout, block, monkeypatch):
    """Proofs from small blocks and edges merged by twos, so that several rounds are needed; every proof leads to the root."""
    monkeypatch.setattr(merkle, "MERGED", 2)
    rows = manifest_rows({"en": 61, "de": 7})
    leaves = merkle.document_leaves(spark.createDataFrame(rows, COLUMNS).repartition(5))
    own = merkle.placed(leaves)
    nodes = merkle.nodes_of(own, fanout)
    levels = {g: tree([r["leaf"] for r in own.where(F.col("grp") == g).orderBy("pos").collect()], fanout) for g in ("+en", "+de")}
    assert sorted(map(tuple, nodes.select("grp", "level", "idx", "hash").collect())) == sorted((g, k, i, x) for g, t in levels.items() for k, level in enumerate(t) if k for i, x in enumerate(level))
    told = merkle.with_proofs(own, nodes, fanout, block).withColumn("top", merkle.folded(F.col("leaf"), F.col("path")))
    for r in told.collect():
        siblings, root = up(levels[r["grp"]], r["pos"], r["leaf"], fanout)
        assert r["top"] == root and "".join(x["before"] + x["after"] for x in r["path"]) == "".join(siblings)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 90), st.integers(2, 5), st.lists(st.integers(1, 89), max_size=6), st.integers(2, 3))
def test_mountain_ranges_of_any_cuts(n, fanout, cuts, merged):
    """Wherever partitions begin, completed nodes and merged edges are the whole tree, each node once."""
    leaves = [h(str(i)) for i in range(n)]
    ends = sorted({0, n, *(c for c in cuts if c < n)})
    found, edges = [], []
    for a, b in itertools.pairwise(ends):
        part = merkle.Range(n, fanout)
        for i in range(a, b):
            part.add(0, i, leaves[i])
        found += part.nodes
        edges.append(part.close())
    while any(edges):
        lots = [merkle.merge_edges(n, fanout, [x for e in edges[i : i + merged] for x in e]) for i in range(0, len(edges), merged)]
        found += [x for done, _ in lots for x in done]
        edges = [still for _, still in lots]
    assert sorted(found) == [(k, i, x) for k, level in enumerate(tree(leaves, fanout)) if k for i, x in enumerate(level)]


# --- filter audit


def slow_audit(rows, labels):
    """rows: doc_id, lang, text; labels: doc_id, quality, toxic."""
    texts = {}
    for i, _, t in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    judged = {}
    for i, g, t in rows:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and texts[t] < i}
        told = [x for x in labels if x[0] is not None and x[0] == i]
        judged.setdefault(g or "", []).append(({f for f, x in fails.items() if x}, any(x[1] == 1 for x in told), any(x[2] == 1 for x in told)))
    out, removed_of = [], {}
    for g, each in judged.items():
        for order in itertools.permutations("ABCDE"):
            left = each
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removed_of[g, f] = removed_of.get((g, f), 0) + len(gone)
                out.append([g, "".join(order), k + 1, f, len(left), len(gone), sum(f in x[0] for x in each) - len(gone), sum(x[0] == {f} for x in each), sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*r, removed_of[r[0], r[3]]) for r in out)


def test_filter_audit(spark):
    rng = np.random.default_rng(5)
    text = lambda n, k: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    long = text(230, 900)
    rows = [(1, "en", long), (2, "en", long), (3, "de", long), (3, "de", long), (None, "de", long), (4, None, None), (5, "", ""), (6, "en", text(260, 20)), (7, "en", "ABC " * 220), (8, "fr", text(210, 900) + " $"), (9, "fr", "é中  " * 300), (10, "fr", "short | One"), (None, None, None)]
    rows += [(20 + i, "en", text(int(rng.integers(150, 260)), 300).replace("w1", "W") + ("#" if i % 4 == 0 else "")) for i in range(12)] + [(40, "en", "word " * 100_000)]
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (3, 1, None), (6, 1, 1), (None, 1, 1), (10, None, 1), (99, 1, 1), *((20 + i, i % 2, i % 3 == 0) for i in range(6))]
    docs = spark.createDataFrame([(i, g, t, "x", "y", "z") for i, g, t in rows], "doc_id long, lang string, text string, part string, A string, good string").repartition(4)
    marks = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs, marks)
    names = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == slow_audit(rows, labels)
    assert not spark.sparkContext._jsc.getPersistentRDDs()  # every survivor frame is released
    assert filter_audit.audit_documents(docs.where("false"), marks).count() == 0
    assert filter_audit.audit_documents(docs, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_every_state_is_counted_once(spark):
    rows = spark.range(64).select(F.lit("p").alias("part"), *((F.col("id").bitwiseAND(1 << k) > 0).alias(x) for k, x in enumerate("XYZ")), F.lit(True).alias("lost"))
    counts = filter_audit.count_states(rows, "XYZ", {"lost": "lost"})
    states = [r["state"] for r in counts.select("state").distinct().collect()]
    assert sorted(states) == list(range(8)) and counts.count() == 3 * 4 + 1
    assert filter_audit.audit(rows, "XYZ", {"lost": "lost"}).where("step = 3").select("kept").distinct().collect()[0][0] == 8


# --- decontamination


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_leaks(text, items, window):
    words = slow_words(text)
    hit, which = set(), set()
    for item, t in items:
        own = slow_words(t)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    which.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(which)


def expanded(spans):
    return [i for s in spans for i in range(s["start"], s["end"])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=24), max_size=5), st.text("abc ", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_automaton_finds_every_window(items, text, window, chunk):
    """Items over two letters, so that everything repeats; packed and unpacked; whatever the chunks."""
    numbers: dict[bytes, int] = {}
    pieces = [(k, [numbers.setdefault(w.encode(), len(numbers)) for w in t.split()]) for k, t in enumerate(items)]
    a = decontaminate.unpack(decontaminate.pack(decontaminate.build(pieces, numbers, [str(k) for k in range(len(items))], window)))
    n, spans, found = decontaminate.matches(decontaminate.words_of(text.encode(), chunk), a)
    assert (n, [i for s, e in spans for i in range(s, e)], sorted(a.names[i] for i in found)) == slow_leaks(text, list(enumerate(items)), window)
    assert all(x[1] < y[0] for x, y in itertools.pairwise(spans))


@settings(max_examples=200, deadline=None)
@given(st.text("aZ9é中 -_\n\t.", max_size=80), st.integers(1, 12))
def test_words_do_not_depend_on_chunks(text, chunk):
    assert [w.decode() for part in decontaminate.words_of(text.encode(), chunk) for w in part] == slow_words(text)


def leak_rows():
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 60, n))
    items = [(k, text(int(rng.integers(12, 60)))) for k in range(12)] + [(20, "Short item"), (20, "other text, of the SAME id"), (None, "no id, but words"), (21, None), (22, "..."), (23, "v1"), (24, text(300)), (25, text(40)), (25, text(40))]
    items.append((30, items[0][1]))
    docs = [(1, None), (2, ""), (3, "..."), (4, "a SHORT\n item here"), (5, "nothing of it"), (None, f"x {items[1][1]} y"), (6, items[2][1].upper().replace(" ", "--")), (6, items[2][1])]
    docs += [(10 + k, f"{text(20)} {' '.join(items[k % 12][1].split()[2 : 2 + 7 + k % 6])} {text(15)}") for k in range(20)] + [(50, items[18][1] + " and " + items[0][1]), (51, f"{'v ' * 100_000}{items[3][1]}"), (52, "y" * 200_000)]
    return docs, items


@pytest.mark.parametrize("block_words, piece", [(200_000, 1000), (60, 24)])
def test_decontamination(spark, block_words, piece):
    """One block and many, whole items and pieces: the same spans and items as by plain loops."""
    docs, items = leak_rows()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_words int").repartition(3)
    tests = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, item string").repartition(2)
    got = decontaminate.find_spans(frame, tests, block_words=block_words, piece=piece).collect()
    assert sorted(((r["doc_id"], r["n_words"], expanded(r["spans"]), r["items"]) for r in got), key=str) == sorted(((i, *slow_leaks(t, items, 10)) for i, t in docs), key=str)
    if piece == 24:
        found, blocks = decontaminate.automata(tests, block_words=block_words, piece=piece)
        assert blocks > 2 and found.count() > 2
    else:
        assert decontaminate.find_spans(frame, tests.where("false")).agg(F.sum(F.size("spans"))).first()[0] == 0
        assert decontaminate.find_spans(frame.where("false"), tests).count() == 0


def test_clean_documents(spark):
    """Spans go, the rest stays as it was; documents that are mostly test items go."""
    docs, items = leak_rows()
    leak = items[4][1]
    extra = [(80, f"Before, (this)!  {leak}.  After - énd"), (81, leak), (82, f"{leak} tail " + "clean " * 60), (83, "clean " * 40 + leak), (84, f"{'one ' * 60}{leak} {'two ' * 60}{leak}")]
    frame = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in docs + extra], "doc_id long, text string, row_ string, n_chars long").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.clean_documents(frame, tests, most_covered=0.9).where("doc_id >= 80").collect()}
    assert set(got) == {80, 82, 83, 84}
    assert got[80]["text"] == "Before, (this)! .  After - énd" and got[80]["n_chars"] == len(got[80]["text"])
    assert got[82]["text"] == "tail " + "clean " * 60 and got[83]["text"] == ("clean " * 40).rstrip()
    assert got[84]["text"].split() == ["one"] * 60 + ["two"] * 60
    told = decontaminate.clean_documents(frame, tests)
    assert told.columns == frame.columns
    left = {r["doc_id"]: r["text"] for r in told.collect()}
    assert {1, 2, 3, 5} <= set(left) and left[5] == "nothing of it" and 81 not in left
    again = decontaminate.find_spans(told.where("doc_id >= 80"), tests)
    assert again.agg(F.sum(F.size("spans"))).first()[0] == 0


def test_queries(spark, duck):
    from evidra.llm import queries
    from tests.conftest import DATA

    got = queries.op11_decontamination(spark, DATA).collect()
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    items = duck.sql("select item_id, text from benchmark").fetchall()
    for r in got[:40]:
        n, hit, which = slow_leaks(docs[r["doc_id"]], items, 10)
        assert tuple(r)[1:] == (n, len(hit), len(which), h(",".join(which)), bool(hit))
