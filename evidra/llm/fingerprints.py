"""Document fingerprints: improbable-feature digests.

Every byte window of a text gets its entropy (in integer arithmetic, so that equal windows have equal values). How often each
entropy value occurs over all windows of all documents gives its rarity rank. A window is a feature if it has the least rank in
at least `popular` of the ranges of consecutive windows that it lies in. Texts from LONG_FROM bytes on have windows of 64
bytes; those below SHORT_UNTIL have windows of 16 bytes, so that they too have several features and survive a small edit;
between the two bounds a text has both, so near copies on either side of one bound share features. A text from SHORT_UNTIL
bytes on and a part of it below LONG_FROM have no kind in common, and may be unlike. Features are hashed into a
chain of Bloom filters of 2048 bits, 160 features each. Two digests are compared filter by filter: the common bits, less those
expected by chance, over the most that could be common; each filter of the shorter digest counts with its best partner.

A text below 16 bytes, or one whose windows are all nearly constant, is one feature as a whole; an empty text has an empty
digest, which is like another empty one (1) and unlike all others (0). Null texts count as empty. Equal texts have equal
fingerprints. In `compare_neighbours`, documents are ordered by id (null first), then text; every input row gives one output
row; other columns are ignored.

Entropies and features are made in blocks of BLOCK windows, so beside a text itself stand two bytes for each of its windows.

Neighbours need the order of all documents. Spark's range partitioning by id and start of the text gives the cuts, as many as
there are partitions times RANGES, whatever the ids; every row goes to its range by binary search, and the first row of each
range is sent to the range before it as well, so each task streams through its ranges with two documents in memory.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import bounded_batches, n_partitions, slices, texts_of


class Kind(NamedTuple):
    """Bytes of a window, windows of a range, and in how many ranges a feature has the least rank."""

    window: int
    range: int
    popular: int


LONG, SHORT = Kind(64, 64, 16), Kind(16, 8, 3)
LONG_FROM, SHORT_UNTIL = 384, 768
LEVELS, LEAST, BLOCK = 1000, 100, 1 << 16
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Ranges of neighbours for each partition; bytes of a text's start that order rows of one id before they are sorted whole.
RANGES, START = 4, 32
_UNIT = 1 << 20
_F = {k.window: np.array([0, *(round(i * np.log2(i) * _UNIT) for i in range(1, k.window + 1))], np.int32) for k in (LONG, SHORT)}
_G = {w: np.diff(f, prepend=np.int32(0)) for w, f in _F.items()}  # what the k-th occurrence of a byte adds


def _block(b: np.ndarray, window: int) -> np.ndarray:
    n, of, adds = len(b), _F[window], _G[window]
    order = np.argsort(b, kind="stable").astype(np.int32)
    key = b[order] * np.int32(n + 2 * window) + order
    rank = np.arange(n, dtype=np.int32)
    upto, since = np.empty(n, np.int32), np.empty(n, np.int32)
    upto[order] = rank - np.searchsorted(key, key - np.int32(window - 1)) + 1  # occurrences in the window that ends here
    since[order] = np.searchsorted(key, key + np.int32(window - 1), side="right") - rank  # in the one that starts here
    total = np.empty(n - window + 1, np.int64)
    total[0] = of[np.bincount(b[:window])].sum()
    np.cumsum(adds[upto[window:]] - adds[since[: n - window]], out=total[1:])
    total[1:] += total[0]
    total *= LEVELS
    total += of[window] // 2
    total //= of[window]
    return LEVELS - total


def entropies(data: bytes, window: int = LONG.window) -> np.ndarray:
    """For each window, its entropy in thousandths of the most that is possible. Blocks carry over window - 1 bytes."""
    n = len(data) - window + 1
    out = np.empty(max(n, 0), np.int16)
    every = np.frombuffer(data, np.uint8)
    for at in range(0, n, BLOCK):
        out[at : at + BLOCK] = _block(every[at : at + BLOCK + window - 1], window)
    return out


def long_entropies(data: bytes) -> np.ndarray:
    return entropies(data) if len(data) >= LONG_FROM else np.empty(0, np.int16)


def edited_entropies(left: bytes, of_left: np.ndarray, right: bytes, of_right: np.ndarray) -> np.ndarray:
    """Entropies of left + right, where of_left and of_right belong to texts that begin with left and right."""
    w = LONG.window
    if min(len(left), len(right)) < w or not len(of_left) or not len(of_right):
        return long_entropies(left + right)
    return np.concatenate([of_left[: len(left) - w + 1], entropies(left[1 - w :] + right[: w - 1]), of_right[: len(right) - w + 1]])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Ranks of the entropy values, the rarest first."""
    ranks = np.empty(LEVELS + 1, np.int32)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:LEAST] = LEVELS + 1  # nearly constant windows say nothing
    return ranks


def features(values: np.ndarray, ranks: np.ndarray, kind: Kind = LONG) -> np.ndarray:
    """Where the selected windows start. Of equal ranks in a range the first counts."""
    n, bits = len(values), 18
    if n <= kind.range:
        r = ranks[values]
        return np.array([int(r.argmin())]) if n and r.min() <= LEVELS else np.empty(0, np.int64)
    votes = np.zeros(n, np.uint8)
    for at in range(0, n - kind.range + 1, BLOCK):
        r = ranks[values[at : at + BLOCK + kind.range - 1]]
        least = (r << bits) | np.arange(len(r), dtype=np.int32)
        size = 1
        while size < kind.range:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = least[(least >> bits) <= LEVELS] & ((1 << bits) - 1)
        votes[at : at + len(r)] += np.bincount(least, minlength=len(r)).astype(np.uint8)
    return np.flatnonzero(votes >= kind.popular)


def parts_of(data: bytes, values: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """The features of a text, as bytes. values: long_entropies of the text; ranks: of long and of short windows."""
    there = False
    if len(data) >= LONG_FROM:
        for i in features(values, ranks[0], LONG).tolist():
            there = True
            yield data[i : i + LONG.window]
    if len(data) < SHORT_UNTIL:
        for i in features(entropies(data, SHORT.window), ranks[1], SHORT).tolist():
            there = True
            yield data[i : i + SHORT.window]
    if data and not there:
        yield data


def digest(data: bytes, values: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The chain of Bloom filters, as integers."""
    chain, bits, held = [], bytearray(FILTER_BITS // 8), 0
    for part in parts_of(data, values, ranks):
        if held == FILTER_FEATURES:
            chain.append(int.from_bytes(bits, "little"))
            bits, held = bytearray(FILTER_BITS // 8), 0
        held += 1
        h = xxhash.xxh3_128_intdigest(part)
        for _ in range(HASHES):
            bits[(h >> 3) & 255] |= 1 << (h & 7)
            h >>= 11
    return [*chain, int.from_bytes(bits, "little")] if held else chain


def to_text(chain: list[int]) -> str:
    return "eb1:" + base64.b64encode(b"".join(x.to_bytes(FILTER_BITS // 8, "little") for x in chain)).decode()


def from_text(text: str) -> list[int]:
    data, k = base64.b64decode(text[4:]), FILTER_BITS // 8
    return [int.from_bytes(data[i : i + k], "little") for i in range(0, len(data), k)]


def likeness(a: list[int], b: list[int]) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    if not a or not b:
        return float(not a and not b)
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if len(a) < len(b) else _one_way(b, a)


def _one_way(a: list[int], b: list[int]) -> float:
    sizes = [x.bit_count() for x in b]
    total = weight = 0.0
    for x in a:
        n = x.bit_count()
        best = 0.0
        for y, m in zip(b, sizes, strict=True):
            chance = n * m / FILTER_BITS
            most = min(n, m)
            if most > chance:
                best = max(best, ((x & y).bit_count() - chance) / (most - chance))
        total += n * best
        weight += n
    return total / weight


def entropy_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all documents have each entropy value: long ones, short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, LEVELS + 1), np.int64)
        for batch in slices(batches):
            for text in texts_of(batch):
                data = text.encode()
                counts[0] += np.bincount(long_entropies(data), minlength=LEVELS + 1)
                if len(data) < SHORT_UNTIL:
                    counts[1] += np.bincount(entropies(data, SHORT.window), minlength=LEVELS + 1)
        flat = counts.ravel()
        there = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(flat[there])], names=["level", "n"])

    bounded_batches(docs.sparkSession)
    parts = docs.selectExpr(f"cast({text_col} as string) text").mapInArrow(run, "level long, n long")
    counts = np.zeros(2 * (LEVELS + 1), np.int64)
    for r in parts.groupBy("level").agg(F.sum("n").alias("n")).collect():  # at most 2 * (LEVELS + 1) rows
        counts[r["level"]] = r["n"]
    return counts.reshape(2, LEVELS + 1)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def by_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, range, borrowed; sorted within partitions, each range whole within one and followed by the row after it."""
    spark = docs.sparkSession
    parts = n_partitions(spark)
    text = f"cast({text_col} as string)"
    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text} text", f"coalesce(cast({id_col} as long), {-(2**63)}L) k", f"substring(coalesce({text}, ''), 1, {START}) start")
    firsts = rows.select("k", "start").repartitionByRange(RANGES * parts, "k", "start").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "start")).alias("x"))
    cuts = sorted((r["x"]["k"], r["x"]["start"].encode()) for r in firsts.collect())  # a row for each range
    shared = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, lent = shared.value, {}
        number = {c: i for i, c in enumerate(cuts)}
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text")
            keys = list(zip(batch.column("k").to_pylist(), (x.encode() for x in batch.column("start").to_pylist()), strict=True))
            at = [bisect_right(cuts, k) - 1 for k in keys]
            yield _placed(ids, texts, at, False)
            for i, k in enumerate(keys):
                if k in number:  # the first row of a range is the least of those with its key; one for each task and range is sent
                    mine = (texts[i].as_py() or "").encode()
                    if k not in lent or mine < lent[k][1]:
                        lent[k] = (ids[i].as_py(), mine)
        out = [(i, t.decode(), number[k] - 1) for k, (i, t) in lent.items() if number[k]]
        if cuts and cuts[0] in lent:  # after the last document comes the first one
            out.append((lent[cuts[0]][0], lent[cuts[0]][1].decode(), len(cuts) - 1))
        if out:
            ids, texts, at = zip(*out)
            yield _placed(pa.array(ids, pa.int64()), pa.array(texts, pa.string()), list(at), True)

    placed = rows.mapInArrow(place, "doc_id long, text string, range int, borrowed boolean")
    order = [F.col("range"), F.col("borrowed"), F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))]
    return placed.repartition(parts, "range").sortWithinPartitions(*order)


def _placed(ids: pa.Array, texts: pa.Array, at: list[int], borrowed: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, texts, pa.array(at, pa.int32()), pa.array([borrowed] * len(at), pa.bool_())], names=["doc_id", "text", "range", "borrowed"])


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its text with the last quarter replaced by the next document's start, and
    how like its own these and the next document's fingerprint are."""
    long_counts, short_counts = entropy_counts(docs, text_col)
    ranks = rarity(long_counts), rarity(short_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, held_range = None, None

        def known(doc_id, text):
            data = text.encode()
            values = long_entropies(data)
            return doc_id, text, data, values, digest(data, values, ranks)

        def compared(this, following) -> tuple:
            doc_id, text, data, values, own = this
            _, next_text, next_data, next_values, next_own = following
            cut = len(text) // 4
            left = text[: len(text) - cut].encode() if cut else data
            right = next_text[:cut].encode()
            edited = left + right
            other = digest(edited, edited_entropies(left, values, right, next_values), ranks)
            return doc_id, len(text), hashlib.sha256(edited).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, next_own)

        for batch in slices(batches):
            for doc_id, text, where, borrowed in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("range").to_pylist(), batch.column("borrowed").to_pylist(), strict=True):
                if borrowed and held is None:
                    continue  # other tasks sent a row with the same key
                this = known(doc_id, text)
                if held is not None and held_range == where:
                    rows.append(compared(held, this))
                held, held_range = (None, None) if borrowed else (this, where)
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return by_ranges(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields, strict=True)], names=[n for n, _ in fields])
