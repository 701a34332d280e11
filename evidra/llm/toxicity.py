"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

A text is a sequence of symbols, one for each character: letters and gaps (gaps that follow each other are one). Letters are a to z
(lower-cased), those of two bytes in UTF-8 by 32 classes and those of the scripts with three (kana, ideographs, Hangul, Thai,
Devanagari and others) by 64, told by their last byte; signs, spaces, full-width forms, and characters of four bytes are gaps. Between three or more letters that stand alone the gaps are skipped, so an insult
spelled with spaces, dots or invisible signs reads like the word. A unit is what starts at STARTS consecutive positions. Two units are as alike as the subsequences of three letters that they share, each
weighed by LAMBDA to the number of positions it skips, up to a span of SPAN; so letters with gaps or foreign characters
between them still count. Landmarks are words of labelled sentences; their kernel matrix gives the Nyström map, and a linear
machine with squared hinge loss is trained on mapped units of labelled sentences. Which unit of a toxic document is the
insult isn't labelled: training alternates between choosing the highest unit of each labelled document and fitting.

A machine that is linear in the landmarks' kernels is linear in the subsequences, so it is stored as one weight for each of
all those of three symbols, and a whole text is scored by looking up and adding weights, at every position. The score of a document is
a logistic function of its two highest units, fitted on the labelled rows.

Null texts count as empty; every input row gives one output row; ids may be null or repeated. Null labels are ignored, and an
id that repeats is used once, with its least text. Without both classes among the training rows, or where no toxic or no clean text
has a word of three letters, the score is the share of label 1. Other columns of the input are ignored or kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import bucket_of, bytes_of, ids_in_hash_order, release_memory, rows_with_ids, sigmoid, slices, training_rows

SPAN, LAMBDA, STARTS, LANDMARKS = 7, 0.7, 9, 192
BITS = 7  # of a symbol
SIZE, LOW = 1 << 3 * BITS, (1 << BITS) - 1
#: At most so many labelled documents of each class, none longer than so many characters, are fitted on.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1_500, 3_000, 20_000
THRESHOLD = 0.3
_PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _symbol_table() -> bytes:
    table = bytearray(256)
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1
    for b in range(128, 192):
        table[b] = 27 + b % 32  # the last byte of an accented letter; upper and lower case differ by 32
    return bytes(table)


_TABLE = _symbol_table()
#: In UTF-8: first bytes of letters of two bytes, which are dropped; characters that count as gaps whole; first bytes of letters of three.
_FIRST = bytes(range(0xC3, 0xE0))
_NO_LETTER = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80-\xbf]{2}|\xe3\x80[\x80-\xbf]|[\xee\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}")
_WIDE = re.compile(rb"[\xe0\xe1\xe3-\xed]")


def _coded(data: bytes) -> np.ndarray:
    """A number for each character: 0, or a letter's."""
    if not data.isascii():
        data = _NO_LETTER.sub(b" ", data)
        if _WIDE.search(data):
            b = np.frombuffer(data, np.uint8)
            s = np.frombuffer(data.translate(_TABLE), np.uint8).copy()
            at = np.flatnonzero(b >= 0xE0)
            s[at + 2] = 59 + b[at + 2] % 64
            keep = (b < 0xC3) | (b > 0xDF)
            keep[at] = keep[at + 1] = False
            return s[keep]
    return np.frombuffer(data.translate(_TABLE, _FIRST), np.uint8)


def symbols(data: bytes) -> np.ndarray:
    """The symbols of a text in UTF-8; 0 is a gap."""
    s = _coded(data)
    letter = s > 0
    s = s[letter | np.r_[True, letter[:-1]]] if len(s) else s
    if len(s) > 4:
        gap = np.r_[True, True, s == 0, True, True]
        alone = ~gap[1:-1] & gap[:-2] & gap[2:]  # one place before and one after the text
        between = gap[2:-2] & alone[:-2] & alone[2:]
        chain = between & (np.r_[False, False, between[:-2]] | np.r_[between[2:], False, False])
        s = s[~chain]
    return s.astype(np.int64)


def position_scores(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each position, what starts there. s must end in SPAN - 1 gaps."""
    n = len(s) - SPAN + 1
    a, b = s[:n] << 2 * BITS, s << BITS
    total = np.zeros(n, np.float32)
    for k in range(2, SPAN):
        ck = s[k : k + n]
        part = np.zeros(n, np.float32)
        for j in range(1, k):
            part += weights[a + b[j : j + n] + ck]
        total += np.float32(LAMBDA ** (k - 2)) * part
    return total


def unit_scores(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0.0], np.cumsum(position_scores(s, weights), dtype=np.float64)])
    return at[STARTS:] - at[:-STARTS] if len(at) > STARTS else at[-1:] - at[:1]


_PAD = np.zeros(SPAN - 1 + STARTS, np.int64)


def two_highest(texts: list[bytes], weights: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """For each text, its highest unit and the highest one apart from that, at least 0 each (a text of gaps has 0)."""
    out = np.zeros((len(texts), 2))
    group: list[int] = []
    size = 0

    def flush() -> None:
        seqs = [symbols(texts[i]) for i in group]
        starts = np.cumsum([0, *(len(x) + len(_PAD) for x in seqs)])
        u = unit_scores(np.concatenate([y for x in seqs for y in (x, _PAD)] + [_PAD]), weights)
        for i, x, at in zip(group, seqs, starts.tolist(), strict=False):
            own = u[at : at + len(x)]
            if not len(own):
                continue
            p = int(own.argmax())
            out[i, 0] = max(own[p], 0)
            rest = [own[: max(p - SPAN - STARTS, 0)], own[p + SPAN + STARTS :]]
            out[i, 1] = max([0.0, *(float(r.max()) for r in rest if len(r))])

    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= most:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


LENGTH = STARTS + SPAN - 1


def window(s: np.ndarray) -> np.ndarray:
    """A unit with what may follow its starts, at its fixed length."""
    return np.concatenate([s, np.zeros(max(0, LENGTH - len(s)), np.int64)])[:LENGTH]


def subsequences(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit (a row), the numbers of its subsequences, 0 where a member is a gap, and the weight of each column."""
    found, weights = [], []
    for j, k in _PAIRS:
        a, b, c = units[:, :STARTS], units[:, j : j + STARTS], units[:, k : k + STARTS]
        found.append(np.where((a > 0) & (b > 0) & (c > 0), a << 2 * BITS | b << BITS | c, 0))
        weights += [LAMBDA ** (k - 2)] * STARTS
    return np.hstack(found), np.array(weights, np.float32)


@dataclass
class Landmarks:
    """at: for each subsequence its row in features, 0 for those that no landmark has; features: (rows, landmarks)."""

    at: np.ndarray
    features: np.ndarray

    def kernel(self, units: np.ndarray, step: int = 64) -> np.ndarray:
        """In steps, as the subsequences of a step stand side by side in memory."""
        out = np.zeros((len(units), self.features.shape[1]), np.float32)
        for i in range(0, len(units), step):
            found, weights = subsequences(units[i : i + step])
            np.einsum("ust,s->ut", self.features[self.at[found]], weights, out=out[i : i + step])
        return out


def choose_landmarks(groups: list[tuple[np.ndarray, int]]) -> Landmarks:
    """From each group of units at most so many in all that aren't nearly another landmark; normalised."""
    marks: list[dict[int, float]] = []
    for units, most in groups:
        found, weights = subsequences(units)
        for idx in found:
            if len(marks) >= most:
                break
            row: dict[int, float] = {}
            for t, w in zip(idx.tolist(), weights.tolist(), strict=True):
                if t:
                    row[t] = row.get(t, 0.0) + w
            size = np.sqrt(sum(v * v for v in row.values()))
            if size and all(sum(v * m.get(t, 0.0) for t, v in row.items()) < 0.95 * size for m in marks):
                marks.append({t: v / size for t, v in row.items()})
    every = sorted({t for m in marks for t in m})
    at = np.zeros(SIZE, np.int32)
    at[every] = np.arange(1, len(every) + 1)
    features = np.zeros((len(every) + 1, max(len(marks), 1)), np.float32)
    for i, m in enumerate(marks):
        features[at[list(m)], i] = list(m.values())
    return Landmarks(at, features)


def fit_machine(parts: list[tuple[np.ndarray, float]], c: float = 4.0, steps: int = 30, block: int = 1024) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps, from (rows, class of 1 or -1). Classes count
    equally. Normal equations are summed over blocks of rows, so beside the rows only a block stands in memory."""
    y = np.concatenate([np.full(len(z), label) for z, label in parts])
    blocks = [(z[i : i + block], label) for z, label in parts for i in range(0, len(z), block)]
    n, m = len(y), parts[0][0].shape[1]
    cost = c * np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * n / 2
    ridge = np.diag([1.0] * m + [1e-3])
    w = np.zeros(m + 1)
    for _ in range(steps):
        gram, side, at = ridge.copy(), np.zeros(m + 1), 0
        for z, label in blocks:
            x = np.hstack([z, np.ones((len(z), 1))])
            on = label * (x @ w) < 1
            weighted = x[on] * cost[at : at + len(z)][on, None]
            gram += weighted.T @ x[on]
            side += label * weighted.sum(0)
            at += len(z)
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of the subsequences
    logistic: tuple[float, float, float]  # of the highest unit, the second one, and the bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        a, b, c = self.logistic
        found = two_highest(texts, self.weights)
        return sigmoid(a * found[:, 0] + b * found[:, 1] + c)


#: Three letters or more of three bytes in a row.
_RUN = re.compile(rb"(?:[\xe0\xe1\xe3-\xed][\x80-\xbf]{2}){3,}")


def _words(data: bytes) -> list[bytes]:
    """Words between spaces; where letters of three bytes run together, each three of them."""
    words = [w for w in (x.strip(b".,;:!?*#$%&|\"'()") for x in data.lower().split()) if len(w) > 2]
    if data.isascii() or not _WIDE.search(data):
        return words
    runs = _RUN.findall(_NO_LETTER.sub(b" ", data))
    return [w for w in words if not _RUN.search(w)] + [r[i : i + 9] for r in runs for i in range(0, len(r) - 8, 3)]


def train(texts: list[bytes], toxic: np.ndarray, rounds: int = 4, seed: int = 7) -> ToxicityModel:
    """texts in UTF-8 with their labels (0 or 1)."""
    n_bad = int(toxic.sum())
    share = (n_bad + 1) / (len(toxic) + 2)
    constant = ToxicityModel(np.zeros(SIZE, np.float32), (0.0, 0.0, float(np.log(share / (1 - share)))))
    if not n_bad or n_bad == len(toxic):
        return constant
    rng = np.random.default_rng(seed)
    bad, good, seen = Counter(), Counter(), set()
    for t, y in zip(texts, toxic, strict=True):
        words = frozenset(_words(t))
        same = xxhash.xxh3_128_digest(b" ".join(sorted(words)))
        if same in seen:
            continue  # copies say nothing new about their words
        seen.add(same)
        (bad if y else good).update(words)
    if not bad or not good:
        return constant
    least = min(2, max(bad.values()))
    odds = {w: (n + 0.5) / (n_bad + 1) / ((good[w] + 0.5) / (len(toxic) - n_bad + 1)) for w, n in bad.items() if n >= least}
    seeds = sorted(odds, key=lambda w: (-bad[w] * np.log(max(odds[w], 1e-9)), w))[: 4 * LANDMARKS]
    seeds = [w for w in seeds if odds[w] > 4] or seeds[:16]
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))[: 4 * LANDMARKS]]
    padded = lambda words: np.array([window(symbols(w)) for w in words]).reshape(-1, LENGTH)
    marks = choose_landmarks([(padded(seeds), 2 * LANDMARKS // 3), (padded(common), LANDMARKS)])
    if not marks.features.any():  # words without three letters
        return constant
    gram = marks.features.T.astype(float) @ marks.features
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-5 * values.max()
    mapped = Landmarks(marks.at, (marks.features @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32))

    # first units: the words that tell most, against words of clean sentences
    lexicon = set(seeds)
    told = [w for t, y in zip(texts, toxic, strict=True) if y for w in dict.fromkeys(_words(t)) if w in lexicon] or seeds
    told = [told[i] for i in rng.permutation(len(told))[:2500]]
    clean_words = sorted(good)
    picked = [clean_words[i] for i in rng.choice(len(clean_words), min(4000, len(clean_words)), replace=False)] if clean_words else []
    positive = np.vstack([padded(told), np.array([window(gapped(symbols(w), rng)) for w in told[:1000]]).reshape(-1, LENGTH)])
    zp, zn = mapped.kernel(positive), mapped.kernel(padded(picked + common))
    sequences = [np.concatenate([symbols(t), _PAD]).astype(np.uint8) for t in texts]
    weights = np.zeros(SIZE, np.float32)
    for step in range(rounds):
        w, bias = fit_machine([(zp, 1.0), (zn, -1.0)])
        table = mapped.features @ w
        table[0] = 0
        weights = table[mapped.at].astype(np.float32)
        if step == rounds - 1:
            break
        hard, soft = [], []
        for small, y in zip(sequences, toxic, strict=True):
            s = small.astype(np.int64)
            u = unit_scores(s, weights)
            p = int(u.argmax())
            if y and u[p] + bias > 0:
                soft.append(window(s[p:]))
            elif not y and u[p] + bias > -1:
                hard.append(window(s[p:]))
        # the highest units of clean documents are negative; those of toxic documents join the words found first
        if hard:
            zn = np.vstack([zn, mapped.kernel(np.array(hard))])
        if soft:
            zp = np.vstack([zp[: len(positive)], mapped.kernel(np.array(soft))])
    x = two_highest(texts, weights)
    return ToxicityModel(weights, _logistic(x, toxic.astype(float)))


def gapped(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The unit with gaps after some letters, or one foreign letter somewhere."""
    letters = unit[unit > 0]
    if rng.random() < 0.5:
        with_gaps = np.stack([letters, np.zeros_like(letters)], 1).ravel()
        return with_gaps[(with_gaps > 0) | (rng.random(len(with_gaps)) < 0.5)]
    at = int(rng.integers(1, max(2, len(letters))))
    return np.insert(letters, min(at, len(letters)), rng.integers(1, 27))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50) -> tuple[float, float, float]:
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(3)
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + ridge * w * [1, 1, 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, ridge, 1e-9])
        move = np.linalg.solve(h, g)
        w -= move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> ToxicityModel:
    """From a bounded sample of the labelled rows outside the held-out fold."""
    rows = training_rows(labels, label)
    bad = ids_in_hash_order(rows.filter("label = 1"), "doc_id", most_toxic)
    good = ids_in_hash_order(rows.filter("label = 0"), "doc_id", most_clean)
    found = []
    if bad or good:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        there = rows_with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "doc_id", bad + good)
        once = there.filter(F.length("text") <= MOST_CHARS).groupBy("doc_id").agg(F.min("text").alias("text"))
        found = sorted((r["doc_id"], r["text"]) for r in once.collect())  # most_toxic + most_clean rows at most
    positive = set(bad)
    toxic = np.array([i in positive for i, _ in found], int)
    texts = [t.encode() for _, t in found]
    del found
    model = train(texts, toxic)
    del texts
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(bytes_of(batch)))], names=["doc_id", "score"])

    scored = docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name=text_col):
            yield batch.filter(pa.array(model.score(bytes_of(batch, text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)
