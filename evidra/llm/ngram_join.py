"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its distinct word 5-grams, as 64-bit hashes. The global order of n-grams goes from rare to frequent:
document frequencies are counted over all documents; the TOP most frequent n-grams come last, by frequency; before them come
the others that occur in two documents or more, by hash (a bitmap of fixed size marks them all, and few more); first come those
in one document alone. (Any total order gives the same links; this one keeps frequent n-grams out of prefixes.) An n-gram that
isn't marked has no second document, so nothing is told about it. A corpus that fills the bitmap gets the same results slower.

1. Two sets that link share an n-gram of both prefixes (the first n - ceil(0.8 n) + 1 in the order). Prefix n-grams are dealt
   to buckets; in each list of documents that share one, the document whose n-gram comes earliest in its own prefix is the
   centre, and the list is told as (centre, member) rows, never as all pairs: both documents of any pair that could link are
   members of a common centre. Lists of n-grams with LONG_LIST documents or more stay cut by task: each piece tells its first
   member, the least of them is the centre (a broadcast row for each such n-gram, TOP at most), and the pieces are told apart.
2. Documents with equal sets are one class. The members of a centre are cut into blocks by hash where they are many.
3. The order is cut into fragments: consecutive ranges of it. For every centre, pair of blocks and fragment, a task counts the
   partial overlaps of the pairs by matrix products over that fragment's n-grams alone; these are summed per pair over the
   fragments, and compared with the sizes. What leaves a task is the forest that spans its links, not the pairs.
4. Lists of up to BLOCK members are compared whole. In a longer one each block is compared within itself and with PIVOTS members
   that all blocks get; that is linear in the list. Then only members that are not yet connected with the bulk of their list
   (its largest part) are compared with all its blocks: members of the bulk are connected already, whatever they share.
5. Connected components of these forests, and the smallest id in each.

The work on a long list grows with its members outside the bulk: a list that falls into many unconnected parts is compared pair
by pair, as no link may be lost. Sets with many rows (a large group of copies) are joined with a broadcast of at most 4 rows for
each partition.

Documents with fewer than n words have one n-gram, their whole sequence; documents without words have none and link with
nothing. Null texts count as empty. Every input row gives one output row. Rows with equal sets link, also when they repeat an
id; rows with null ids take part, and their component is the smallest id that is not null, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import bounded_batches, bytes_of, join_counted, n_partitions, release_memory, slices, small_side, staged
from evidra.llm.components import components

WORDS, PERCENT = 5, 80
#: The most frequent n-grams that have their place in the order by frequency: 12 bytes each, sent to every executor.
TOP = 1 << 20
#: All that occur twice or more are marked in a bitmap of so many bits by the start of their hash, sent as well.
MARK_BITS = 27
FRAGMENTS, BLOCK, PIVOTS, ORDER_BITS, FLUSH = 4, 64, 4, 40, 1_000_000
#: N-grams of so many documents have a list of their own, which is cut by task instead of gathering in a bucket.
LONG_LIST = 4096
BROADCAST_DOCS = 1_000_000
_U = np.uint64


class _Hashes(dict):
    """Hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(data: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct n-grams of a text in UTF-8, as hashes. bytes.lower and bytes.split know ASCII letters and spaces only."""
    words = data.lower().split()
    if not words:
        return np.empty(0, _U)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    a = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    m = len(a) - n + 1
    h = a[:m].copy()
    for k in range(1, n):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += a[k : k + m]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return np.unique(h)


def class_of(grams: np.ndarray) -> int:
    """A number that equal sets share, as a signed 64-bit integer."""
    return int(np.array(xxhash.xxh3_64_intdigest(grams.tobytes()), _U).astype(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of this size has with any set that it links with."""
    return -(-percent * n // 100)


def _pack(a: np.ndarray) -> bytes:
    """Integers, byte planes apart, compressed; ascending ones should come as differences."""
    return zstandard.compress(np.array([len(a), a.itemsize], "<u4").tobytes() + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.decompress(data)
    n, size = np.frombuffer(raw[:8], "<u4").tolist()
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, 8).reshape(size, n).T).view(dtype).reshape(n)


def _deltas(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _from_deltas(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, _U), dtype=_U)


def _bucket_cuts(values: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket's values start, for ascending values of ORDER_BITS bits."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << ORDER_BITS) // buckets).astype(_U)
    return [0, *np.searchsorted(values, edges).tolist(), len(values)]


def _short(grams: np.ndarray) -> np.ndarray:
    return grams >> _U(64 - ORDER_BITS)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text", f"xxhash64(coalesce(cast({text_col} as string), '')) hash")


@dataclass
class Order:
    """The most frequent n-grams (shortened hashes, ascending) with their document frequencies, and the bitmap."""

    grams: np.ndarray
    counts: np.ndarray
    marks: np.ndarray


def _mark(short: np.ndarray) -> np.ndarray:
    return short >> _U(ORDER_BITS - MARK_BITS)


def _slice_of(bucket: int, buckets: int) -> tuple[int, int]:
    """The bytes of the bitmap that a bucket's n-grams can fall into; neighbours may share one."""
    cut = ORDER_BITS - MARK_BITS + 3
    return (bucket << ORDER_BITS) // buckets >> cut, (((bucket + 1) << ORDER_BITS) // buckets - 1 >> cut) + 1


def global_order(rows: DataFrame, n: int = WORDS, top: int = TOP) -> Order:
    """At most about top n-grams by frequency, and the bitmap, from the document frequencies of all n-grams."""
    parts = n_partitions(rows.sparkSession)
    buckets = 2 * parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = _bucket_cuts(values, buckets)
            rows = [(k, _deltas(values[a:b]), _pack(np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return _table(rows, (pa.int32(), pa.binary(), pa.binary()), ("bucket", "grams", "counts"))

        for batch in slices(batches):
            for data in bytes_of(batch):
                held.append(_short(shingles(data, n)))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held = []
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in _groups(batches, 1):
            values = np.concatenate([_from_deltas(g[1]) for g in group])
            counts = np.concatenate([_unpack(g[2], np.uint32) for g in group]).astype(np.int64)
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            values, counts = values[start], np.add.reduceat(counts, start)
            keep = np.flatnonzero(counts > 1)
            low, high = _slice_of(bucket, buckets)
            bits = np.zeros(8 * (high - low), np.uint8)
            bits[_mark(values[keep]).astype(np.int64) - 8 * low] = 1
            most = max(1, top // buckets)
            if len(keep) > most:
                keep = np.sort(keep[np.argpartition(-counts[keep], most)[:most]])
            found = (values[keep].tobytes(), np.minimum(counts[keep], 2**30).astype(np.int32).tobytes(), low, np.packbits(bits, bitorder="little").tobytes())
            yield _table([found], (pa.binary(), pa.binary(), pa.int64(), pa.binary()), ("grams", "counts", "low", "marks"))

    counted = rows.select("text").mapInArrow(count, "bucket int, grams binary, counts binary")
    merged = counted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "grams binary, counts binary, low long, marks binary")
    found = merged.collect()  # 12 bytes * top and the bitmap
    grams = np.concatenate([np.empty(0, _U), *(np.frombuffer(r["grams"], _U) for r in found)])
    counts = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r["counts"], np.int32) for r in found)])
    order = np.argsort(grams)
    marks = np.zeros(1 << MARK_BITS - 3, np.uint8)
    for r in found:
        part = np.frombuffer(r["marks"], np.uint8)
        marks[r["low"] : r["low"] + len(part)] |= part
    del found
    out = Order(grams[order], counts[order], marks)
    release_memory()
    return out


def frequency(grams: np.ndarray, order: Order) -> np.ndarray:
    """By what an n-gram is ordered: its frequency if it is among the most frequent, 1 if it is marked, else 0."""
    short = _short(grams)
    at = _mark(short)
    marked = (order.marks[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(np.int32)
    if not len(order.grams):
        return marked
    at = np.minimum(np.searchsorted(order.grams, short), len(order.grams) - 1)
    return np.where(order.grams[at] == short, order.counts[at], marked)


def prefix(grams: np.ndarray, order: Order, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those n-grams, in the global order, of which a linking set must share one, their places and by what they are ordered;
    without those that have no second document."""
    f = frequency(grams, order)
    at = np.argsort(f, kind="stable")[: len(grams) - needed(len(grams), percent) + 1]  # by hash among equals, as grams ascend
    places = np.flatnonzero(f[at] > 0)
    return grams[at[places]], places, f[at[places]]


def prefixes(rows: DataFrame, top, n: int, percent: int, buckets: int, long_list: int = LONG_LIST) -> DataFrame:
    """kind 0: a document (ref, doc_id, the hash of its text, its set's size and class); kind 1: for a bucket, n-grams and who has
    them in a prefix; kind 2: for a frequent n-gram (class) who has it, and the first of these (doc_id) with its place (n_grams)."""
    schema = "kind int, ref long, doc_id long, hash long, n_grams long, class long, bucket int, grams binary, refs binary, places binary"
    names = tuple(x.split()[0] for x in schema.split(", "))
    types = (pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        base = TaskContext.get().partitionId() << 36
        grams: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        places: list[np.ndarray] = []
        ref = first = size = 0
        classes: set[int] = set()
        lists: dict[int, list[tuple[int, int]]] = {}

        def flush() -> pa.RecordBatch:
            own = [(2, base + first, base + first + min(x)[1], None, min(x)[0], gram, None, None, _pack(np.array([o for _, o in x], np.uint32)), None) for gram, x in lists.items()]
            g, o, p = np.concatenate(grams), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(g, kind="stable")
            g, o, p = g[order], o[order], p[order]
            cuts = _bucket_cuts(g, buckets)
            out = [(1, base + first, None, None, None, None, k, _deltas(g[a:b]), _pack(o[a:b]), _pack(p[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return _table(out + own, types, names)

        for batch in slices(batches):
            out = []
            for doc_id, of_text, data in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), bytes_of(batch), strict=True):
                own = shingles(data, n)
                kind = class_of(own)
                out.append((0, base + ref, doc_id, of_text, len(own), kind, None, None, None, None))
                if len(own) and kind not in classes:  # one of the equal sets that this task holds is enough
                    classes.add(kind)
                    head, place, often = prefix(own, known, percent)
                    size += len(head)
                    head, place = _short(head), (place * 200 // len(own)).astype(np.uint8)
                    for k in np.flatnonzero(often >= long_list).tolist():
                        lists.setdefault(int(head[k]), []).append((int(place[k]), ref - first))
                    grams.append(head[often < long_list])
                    owners.append(np.full(len(grams[-1]), ref - first, np.uint32))
                    places.append(place[often < long_list])
                ref += 1
                if size > FLUSH // 2:
                    yield flush()
                    grams, owners, places, first, size, classes, lists = [], [], [], ref, 0, set(), {}
            yield _table(out, types, names)
        if size:
            yield flush()
        grams, owners, places, lists, classes = [], [], [], {}, set()
        release_memory()

    return rows.mapInArrow(run, schema)


def centres(postings: DataFrame) -> DataFrame:
    """(centre, member), as refs, from the lists of documents that share a prefix n-gram."""
    parts = n_partitions(postings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 1):
            g = np.concatenate([_from_deltas(r[2]) for r in group])
            o = np.concatenate([_unpack(r[3], np.uint32).astype(np.int64) + r[1] for r in group])
            p = np.concatenate([_unpack(r[4], np.uint8) for r in group])
            order = np.lexsort((o, p, g))
            g, o = g[order], o[order]
            new = np.r_[True, g[1:] != g[:-1]]
            centre = o[np.flatnonzero(new)][np.cumsum(new) - 1]
            pairs = np.unique(np.stack([centre, o], 1)[centre != o], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["centre", "member"])

    dealt = postings.select("bucket", "ref", "grams", "refs", "places").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "centre long, member long")


def long_centres(pieces: DataFrame) -> DataFrame:
    """(centre, member), as refs, from the pieces of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for centre, ref, refs in zip(*(batch.column(c).to_pylist() for c in ("centre", "ref", "refs")), strict=True):
                members = _unpack(refs, np.uint32).astype(np.int64) + ref
                members = members[members != centre]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), centre)), pa.array(members)], names=["centre", "member"])

    first = pieces.groupBy("class").agg(F.min(F.struct("n_grams", "doc_id")).alias("x")).select("class", F.col("x.doc_id").alias("centre"))
    return pieces.join(F.broadcast(first), "class").select("centre", "ref", "refs").mapInArrow(run, "centre long, member long")


def segments(rows: DataFrame, top, n: int, fragments: int) -> DataFrame:
    """For the documents of rows (text, class): class, n_grams, fragment, and the n-grams in that fragment of the order. The last
    fragment holds the most frequent n-grams; the ones before are cut from the others by hash, which is their order. N-grams
    that no second document has come first in the order and are left out: they overlap with nothing."""
    schema = "class long, n_grams long, fragment int, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        for batch in slices(batches):
            out = []
            for kind, data in zip(batch.column("class").to_pylist(), bytes_of(batch), strict=True):
                own = shingles(data, n)
                f = frequency(own, known)
                part = np.where(f > 1, _U(fragments - 1), (_short(own) * _U(max(fragments - 1, 1))) >> _U(ORDER_BITS))
                out += [(kind, len(own), k, own[(part == k) & (f > 0)].tobytes()) for k in range(fragments)]
            yield _table(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), ("class", "n_grams", "fragment", "grams"))

    return rows.mapInArrow(run, schema)


def partial_overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams of this fragment any two of the sets share."""
    m = len(grams)
    sizes = [len(g) for g in grams]
    every = np.concatenate(grams) if m else np.empty(0, _U)
    if m == 2:
        both = len(every) - len(np.unique(every))
        return np.array([[sizes[0], both], [both, sizes[1]]], np.int32)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((m, m), np.float32)
    _, column = np.unique(column, return_inverse=True)
    for start in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        here = (column >= start) & (column < start + 4096)
        x = np.zeros((m, 4096), np.float32)
        x[owner[here], column[here] - start] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int32)


def span(links: np.ndarray) -> np.ndarray:
    """For each document the smallest one that it is linked with, over any number of links (a matrix)."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def long_lists(members: DataFrame, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(centre, class, m, blocks, own) for members (centre, class), and the pivots (centre, class) of lists beyond a block. Pivots
    are the classes whose hashes are least; the least of every block comes to the choice."""
    sizes = staged(members.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).select("centre", F.col("n").alias("m"), "n"), "sizes")
    cut = join_counted(members, sizes, "centre", "n").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    ranked = cut.filter("blocks > 1").groupBy("centre", "own").agg(F.min_by("class", F.xxhash64("class", F.lit(3))).alias("class"))
    first = ranked.groupBy("centre").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("class", F.lit(3)).alias("h"), "class"))), 1, pivots).alias("x"))
    return cut, first.select("centre", F.explode("x.class").alias("class"))


def first_round(cut: DataFrame, pivots: DataFrame) -> DataFrame:
    """(centre, i, j, class): each block with itself and the pivots."""
    own = cut.select("centre", F.col("own").alias("i"), F.col("own").alias("j"), "class")
    blocks = cut.filter("blocks > 1").select("centre", "blocks").distinct()
    sent = pivots.join(blocks, "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "class")
    return own.unionByName(sent.select("centre", "i", F.col("i").alias("j"), "class")).distinct()


def second_round(cut: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(centre, i, j, class): for the members outside the bulk of a long list, their blocks with all blocks. Blocks of the bulk have
    negative numbers and never meet each other."""
    labelled = cut.filter("blocks > 1").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    parts = labelled.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("k"))
    bulk = parts.groupBy("centre").agg(F.max_by("root", F.struct("k", "root")).alias("bulk"), F.sum("k").alias("m"), F.max("k").alias("most"))
    bulk = staged(bulk.filter("m > most").withColumn("n", F.col("m")), "bulk")
    told = join_counted(labelled.select("centre", "class", "root"), bulk, "centre", "n").filter("bulk is not null")
    calm = F.col("root") == F.col("bulk")
    n_out, n_in = F.ceil((F.col("m") - F.col("most")) / block).cast("int"), F.ceil(F.col("most") / block).cast("int")
    own = F.when(calm, -1 - F.pmod(F.xxhash64("class"), n_in)).otherwise(F.pmod(F.xxhash64("class"), n_out)).cast("int")
    out = F.sequence(F.lit(0), n_out - 1)
    others = F.when(calm, out).otherwise(F.concat(out, F.sequence(-n_in, F.lit(-1))))
    dealt = told.select("centre", "class", own.alias("own"), F.explode(others).alias("other"))
    return dealt.select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class")


def link_forest(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what the links among the classes of each (centre, i, j) connect. dealt: (centre, i, j, class)."""
    parts = n_partitions(dealt.sparkSession)
    work = dealt.join(sets, "class").select("centre", "i", "j", "fragment", "class", "n_grams", "grams")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (centre, i, j, fragment), group in _groups(batches, 4):
            group = sorted({r[4]: r for r in group}.values(), key=lambda r: r[4])  # rows that repeat an id have the same segments
            c = partial_overlaps([np.frombuffer(r[6], _U) for r in group])
            upper = np.triu_indices(len(group), 1)
            yield _table(
                [(centre, i, j, fragment, np.array([r[4] for r in group]).tobytes(), np.array([r[5] for r in group]).tobytes(), zstandard.compress(c[upper].tobytes(), 1))],
                (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()),
                ("centre", "i", "j", "fragment", "classes", "sizes", "overlaps"),
            )

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 3):
            kinds, n = np.frombuffer(group[0][4], np.int64), np.frombuffer(group[0][5], np.int64)
            m = len(kinds)
            if m < 2:
                continue
            total = sum(np.frombuffer(zstandard.decompress(r[6]), np.int32).astype(np.int64) for r in group)
            a, b = np.triu_indices(m, 1)
            yes = 100 * total >= percent * (n[a] + n[b] - total)
            links = np.zeros((m, m), bool)
            links[a[yes], b[yes]] = links[b[yes], a[yes]] = True
            root = span(links)
            leaf = np.flatnonzero(root != np.arange(m))
            if len(leaf):
                yield pa.RecordBatch.from_arrays([pa.array(kinds[root[leaf]]), pa.array(kinds[leaf])], names=["a", "b"])

    keys = ["centre", "i", "j", "fragment"]
    partial = work.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(count, "centre long, i int, j int, fragment int, classes binary, sizes binary, overlaps binary")
    summed = partial.repartition(parts, *keys[:3]).sortWithinPartitions(*keys[:3]).mapInArrow(sum_up, "a long, b long")
    return summed.distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows whose first columns are equal, from batches that are sorted by them."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row)
    if held:
        yield at, held


def _table(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, top: int = TOP, fragments: int = FRAGMENTS, block: int = BLOCK, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id, class for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _read(docs, id_col, text_col)
    known = spark.sparkContext.broadcast(global_order(rows, n, top))
    both = staged(prefixes(rows, known, n, percent, 2 * n_partitions(spark), long_list), "prefixes")
    table = both.filter("kind = 0").select("ref", "doc_id", "hash", "n_grams", "class")
    lists = staged(centres(both.filter("kind = 1")).unionByName(long_centres(both.filter("kind = 2"))).distinct(), "told")
    heads = lists.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).join(table.select(F.col("ref").alias("centre"), F.col("class").alias("c")), "centre")
    pairs = join_counted(lists, staged(heads, "heads"), "centre", "n").join(table.select(F.col("ref").alias("member"), F.col("class").alias("m")), "member")
    pairs = staged(pairs.filter("c <> m").select("c", "m").distinct(), "pairs")
    members = pairs.select(F.col("c").alias("centre"), F.col("m").alias("class")).unionByName(pairs.select(F.col("c").alias("centre"), F.col("c").alias("class"))).distinct()
    # for each set how many rows have it, and one of them by id and text (one with an id if there is one)
    of = table.filter("n_grams > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("of"), F.count(F.lit(1)).alias("n"))
    classes = staged(of.select("class", F.col("of.doc_id").alias("of_id"), F.col("of.hash").alias("of_hash"), "n"), "classes")
    wanted = staged(classes.drop("n").join(members.select("class").distinct(), "class", "left_semi"), "wanted")
    told = wanted.agg(F.count(F.lit(1)).alias("n"), F.count("of_id").alias("ids")).first()
    texts = rows.join(small_side(wanted, told["n"], BROADCAST_DOCS), (F.col("hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("class", "text")
    if told["ids"] < told["n"]:  # rows without an id can repeat a text
        texts = texts.dropDuplicates(["class"])
    sets = staged(segments(texts, known, n, fragments), "segments")
    cut, pivots = long_lists(members, block, PIVOTS)
    cut = staged(cut, "lists")
    if cut.filter("blocks > 1").isEmpty():
        edges = staged(link_forest(cut.select("centre", F.lit(0).alias("i"), F.lit(0).alias("j"), "class"), sets, percent), "forest")
    else:
        edges = staged(link_forest(first_round(cut, pivots), sets, percent), "forest")
        outside = staged(second_round(cut, components(edges), block), "outside")
        if not outside.isEmpty():
            edges = edges.unionByName(staged(link_forest(outside, sets, percent), "forest"))
    found = components(edges)
    rooted = classes.select("class", F.col("of_id").alias("least"), "n").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = staged(rooted.join(least, "root").select("class", "component_id", "n"), "by_class")
    out = join_counted(table.select("doc_id", "n_grams", "class"), by_class, "class", "n")
    own = F.when(F.col("n_grams") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n_grams").alias("n_shingles"), own.alias("component_id"), F.col("class"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their group of near copies. Rows with null ids stay;
    where an id repeats with different texts, all its rows stay if one does."""
    found = near_components(docs.select(id_col, text_col), id_col, text_col, **options)
    stays = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = staged(stays.filter("not stays").select("doc_id"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(small_side(gone, gone.count(), BROADCAST_DOCS), "doc_id", "left_anti").select("row.*")
