"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of whole texts (shares of upper-case letters, symbols, repeated words and lines, and so on) come from one pass.
Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node becomes a conjunctive
rule, and a logistic model with an L1 penalty (proximal gradient) picks few rules and weighs them. The rules are compiled
into Spark column expressions, so scoring is a projection over the statistics.

Null texts count as empty; empty texts get a score from their statistics, too. Every input row gives one output row; ids may
be null or repeated; other columns of the input are ignored. Labels that are null are ignored; a labelled id that repeats is used
once, with its largest label and the text whose statistics are least. With fewer than two classes among the training rows the
score is the share of label 1 (0.5 without rows); so it is where no statistic tells the rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import bucket_of, bytes_of, ids_in_hash_order, rows_with_ids, sigmoid, slices, training_rows

#: At most so many labelled rows are fitted on; all rows count in everything else.
MOST_TRAINING_ROWS = 12_000
THRESHOLD = 0.7
STATS = (
    "n_bytes", "n_words", "mean_word", "long_words", "upper", "digits", "symbols", "punctuation", "non_ascii", "pipes", "bangs",
    "distinct_words", "top_word", "same_next", "pair_repeat", "n_lines", "line_repeat", "words_per_line", "ends", "junk_words",
)
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL, _PUNCT = b"#$%&*@^~<>{}[]\\_=+", b".,;:!?'\"()-/|"
_HIGH = bytes(range(128, 256))


def stats_of(data: bytes) -> tuple[float, ...]:
    """The statistics of a text in UTF-8, in the order of STATS."""
    n = len(data)
    words = data.split()
    m = len(words)
    left = lambda drop: n - len(data.translate(None, drop))
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    shape = max(m, 1)
    if m > 1:
        same = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:])))
    else:
        same, pairs = 0, m - 1
    top = 0.0
    if m:
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        top = max(seen.values()) / m
    junk = sum(1 for w in distinct if not w[-1:].isalnum() and w[-1:] in b"!#$%&*|") if m else 0
    return (
        float(n), float(m), n / shape, float((sizes > 20).sum()) / shape, left(_UPPER) / max(n, 1), left(_DIGIT) / max(n, 1), left(_SYMBOL) / max(n, 1), left(_PUNCT) / max(n, 1),
        left(_HIGH) / max(n, 1), data.count(b"|") / shape, data.count(b"!") / shape, len(distinct) / shape, top, same / shape, 1 - pairs / max(m - 1, 1) if m > 1 else 0.0,
        float(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1), data.count(b".") / shape, junk / max(len(distinct), 1),
    )


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a double column for each of STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([stats_of(x) for x in bytes_of(batch)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, over, cut): value > cut if over, else value <= cut."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, over, cut in self.terms:
            out &= (x[:, STATS.index(name)] > cut) == over
        return out

    def column(self) -> Column:
        parts = [F.col(name) > cut if over else F.col(name) <= cut for name, over, cut in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The score as an expression over the columns of text_stats."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]) -> tuple[list, np.ndarray]:
    """A regression tree on gradients g with weights h: the terms of each node below the root, and its fitted values."""
    nodes: list[tuple] = []
    fit = np.zeros(len(g))

    def split(rows: np.ndarray, terms: tuple) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(terms) < depth and len(rows) >= 2 * least:
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                at = np.searchsorted(cut, x[rows, k], side="left")  # value <= cut[i] where at <= i
                n = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
                gl = np.cumsum(np.bincount(at, g[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(at, h[rows], len(cut) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < least) | (len(rows) - n < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (k, float(cut[i])))
        if best[1] is None:
            fit[rows] = gs / (hs + 1)
            return
        k, cut_at = best[1]
        under = x[rows, k] <= cut_at
        for part, over in ((rows[under], False), (rows[~under], True)):
            path = (*terms, (STATS[k], over, cut_at))
            nodes.append(path)
            split(part, path)

    split(np.arange(len(g)), ())
    return nodes, fit


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleEnsemble:
    """Boosted trees, their paths as rules, then lasso logistic weights."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    cuts = [c[:-1] if len(c) and c[-1] >= x[:, k].max() else c for k, c in enumerate(cuts)]
    least = max(5, len(y) // 400)
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = sigmoid(f)
        nodes, fit = grow(x, y - p, p * (1 - p), depth, least, cuts)
        f += 0.4 * fit
        paths.update(dict.fromkeys(nodes))
    rules = [Rule(p) for p in paths]
    if not rules:  # nothing tells the rows apart
        return RuleEnsemble(float(f[0]))
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    _, keep = np.unique(z, axis=1, return_index=True)
    keep = np.sort(keep)
    z, rules = z[:, keep], [rules[i] for i in keep]
    scale = np.maximum(z.std(0), 0.05)
    mean = z.mean(0)
    zs = (z - mean) / scale
    step = 4 / max(np.linalg.norm(zs, 2) ** 2 / len(y), 1e-9)
    w, b, v, t = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(z.shape[1]), 1.0
    for _ in range(steps):  # FISTA
        r = sigmoid(zs @ v + b) - y
        b -= 2 * r.mean()
        new = v - step * (zs.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    chosen = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[chosen] / scale[chosen]
    return RuleEnsemble(float(b - (weights * mean[chosen]).sum()), [rules[i] for i in chosen], [float(x) for x in weights])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINING_ROWS) -> RuleEnsemble:
    rows = training_rows(labels, label)
    ids = ids_in_hash_order(rows, "doc_id", most)
    if not ids:
        return fit_rules(np.zeros((0, len(STATS))), np.zeros(0))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    once = text_stats(rows_with_ids(given, "doc_id", ids)).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("x")).select("doc_id", "x.*")  # one text for each id
    found = once.join(F.broadcast(rows_with_ids(rows, "doc_id", ids)), "doc_id")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).select(*STATS, "label").toPandas()
    return fit_rules(table[list(STATS)].to_numpy(np.float64), table["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = text_stats(docs).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
