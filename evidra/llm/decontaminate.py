"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and all characters beyond ASCII. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. A word of a document is hit if it lies in an occurrence of
a window.

1. Items are cut into pieces of at most PIECE words that overlap by window - 1, so that the pieces have exactly the item's
   windows, and dealt to blocks of at most `block_words` words; more blocks are taken until none holds more.
2. A task builds the automaton of a block over numbered words: states, suffix links and lengths, the items whose windows each
   state of that depth has, and the states of whole short items. It is packed into arrays of some 40 bytes a word.
3. The words of every document stream through the automaton, a chunk of bytes at a time, so a text of any length takes the memory
   of a chunk beside itself. The state and the length of the longest match that ends at the word are tracked; a match of `window`
   words, or a whole short item, adds its words to the hit spans, and the items of the window.
4. A block's automaton is broadcast: its size is bounded by block_words. A benchmark of several blocks takes a pass over the
   documents for each; spans and items of the same row are united.

`clean_documents` takes the spans out of the texts, and drops documents of which they cover more than a share.

Rows: null and empty texts have no words. Null ids are ids; repeated rows count each. Items with the same id count as one item with
the windows of all; a null item id is the empty string. Empty tables give no rows, or rows without hits. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import bounded_batches, bytes_of, slices, staged

#: Words of a window, of a piece of an item, and of a block at most; bytes of a text that are cut into words at a time.
WINDOW, PIECE, BLOCK_WORDS, CHUNK = 10, 1000, 200_000, 1 << 20
#: Lower-cases A-Z and makes every separator a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS, _ITEMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def words_of(text: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in lists, a chunk of bytes at a time (or a longer word)."""
    start = 0
    while start < len(text):
        part = text[start : start + chunk].translate(FOLD)
        if start + chunk < len(text):
            end = part.rfind(b" ")
            if end < 0:  # a word that is longer than a chunk
                ahead = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, start + chunk)
                end = (ahead.start() if ahead else len(text)) - start
                part = text[start : start + end].translate(FOLD)
            part = part[:end]
        yield part.split()
        start += max(len(part), 1)


class Automaton(NamedTuple):
    """A generalised suffix automaton over numbered words. State 0 is the empty string.

    moves: state * len(words) + word -> state; link, length: by state; deep: by state, its ancestor (or itself) that has the suffix of
    `window` words, or -1; items: by such a state, items with that window; whole: by state, (words, item) of the short items that it
    has whole; mark: by state, the nearest of itself and its ancestors with some, or -1."""

    window: int
    names: list[str]
    words: dict[bytes, int]
    moves: dict[int, int]
    link: list[int]
    length: list[int]
    deep: list[int]
    items: dict[int, list[int]]
    whole: dict[int, list[tuple[int, int]]]
    mark: list[int]


def build(pieces: list[tuple[int, list[int]]], words: dict[bytes, int], names: list[str], window: int) -> Automaton:
    """The automaton of pieces (item number, numbers of its words)."""
    v = max(len(words), 1)
    link, length, out, moves = [-1], [0], [[]], {}  # out: words with a move, by state

    def copy_moves(a: int, b: int) -> None:
        out[b] = out[a][:]
        for w in out[a]:
            moves[b * v + w] = moves[a * v + w]

    def extend(last: int, w: int) -> int:
        q = moves.get(last * v + w)
        if q is not None:  # another piece has this string already
            if length[q] == length[last] + 1:
                return q
            return split(last, w, q)
        new = len(link)
        link.append(0), length.append(length[last] + 1), out.append([])
        p = last
        while p >= 0 and p * v + w not in moves:
            moves[p * v + w] = new
            out[p].append(w)
            p = link[p]
        if p >= 0:
            q = moves[p * v + w]
            link[new] = q if length[q] == length[p] + 1 else split(p, w, q)
        return new

    def split(p: int, w: int, q: int) -> int:
        copy = len(link)
        link.append(link[q]), length.append(length[p] + 1), out.append([])
        copy_moves(q, copy)
        link[q] = copy
        while p >= 0 and moves.get(p * v + w) == q:
            moves[p * v + w] = copy
            p = link[p]
        return copy

    for _, ids in pieces:
        last = 0
        for w in ids:
            last = extend(last, w)
    # suffix links lead to shorter strings, so states in order of length come after their ancestors
    deep, mark = [-1] * len(link), [-1] * len(link)
    items: dict[int, set[int]] = {}
    whole: dict[int, list[tuple[int, int]]] = {}
    order = sorted(range(len(link)), key=length.__getitem__)
    for s in order:
        if length[s] >= window:
            deep[s] = s if length[link[s]] < window else deep[link[s]]
    for item, ids in pieces:
        s = 0
        for k, w in enumerate(ids):
            s = moves[s * v + w]
            if k + 1 >= window:
                items.setdefault(deep[s], set()).add(item)
        if 0 < len(ids) < window:
            whole.setdefault(s, []).append((len(ids), item))
    for s in order:
        mark[s] = s if s in whole else mark[link[s]] if s else -1
    return Automaton(window, names, words, moves, link, length, deep, {s: sorted(x) for s, x in items.items()}, {s: sorted(set(x)) for s, x in whole.items()}, mark)


def matches(chunks: Iterator[list[bytes]], a: Automaton) -> tuple[int, list[list[int]], set[int]]:
    """(words, hit spans as [first, end) word numbers, items): a text's words streamed through the automaton."""
    v, number, moves, link, length, deep, mark, window = max(len(a.words), 1), a.words.get, a.moves.get, a.link, a.length, a.deep, a.mark, a.window
    state, size, at = 0, 0, 0
    spans: list[list[int]] = []
    seen: set[int] = set()
    items: set[int] = set()

    def hit(start: int, end: int) -> None:
        while spans and spans[-1][0] >= start:
            end = max(end, spans.pop()[1])
        if spans and spans[-1][1] >= start:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])

    for chunk in chunks:
        for at, w in enumerate(map(number, chunk), at + 1):
            if w is None:
                state = size = 0
                continue
            to = moves(state * v + w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = moves(state * v + w)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                hit(at - window, at)
                if deep[state] not in seen:
                    seen.add(deep[state])
                    items.update(a.items[deep[state]])
            s = mark[state]
            while s >= 0:
                for words, item in a.whole[s]:
                    if words <= size:
                        hit(at - words, at)
                        items.add(item)
                s = mark[link[s]] if s else -1
    return at, spans, items


def pack(a: Automaton) -> bytes:
    """The automaton as arrays in an Arrow stream."""
    flat = {
        "names": pa.array(a.names, pa.string()), "words": pa.array(list(a.words), pa.binary()), "keys": pa.array(np.fromiter(a.moves, np.int64, len(a.moves))), "to": pa.array(np.fromiter(a.moves.values(), np.int32, len(a.moves))),
        "link": pa.array(np.array(a.link, np.int32)), "length": pa.array(np.array(a.length, np.int32)), "deep": pa.array(np.array(a.deep, np.int32)), "mark": pa.array(np.array(a.mark, np.int32)),
        "deep_state": pa.array(list(a.items), pa.int32()), "deep_items": pa.array(list(a.items.values()), pa.list_(pa.int32())),
        "whole_state": pa.array(list(a.whole), pa.int32()), "whole_items": pa.array([[x for pair in p for x in pair] for p in a.whole.values()], pa.list_(pa.int32())), "window": pa.array([a.window], pa.int32()),
    }
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in flat.values()], names=list(flat))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> Automaton:
    batch = pa.ipc.open_stream(data).read_next_batch()
    x = {n: batch.column(n).flatten() for n in batch.schema.names}
    get = lambda n: x[n].to_pylist()
    whole = {s: list(zip(p[::2], p[1::2], strict=True)) for s, p in zip(get("whole_state"), get("whole_items"), strict=True)}
    return Automaton(get("window")[0], get("names"), {w: k for k, w in enumerate(get("words"))}, dict(zip(get("keys"), get("to"), strict=True)), get("link"), get("length"), get("deep"), dict(zip(get("deep_state"), get("deep_items"), strict=True)), whole, get("mark"))


def pieces_of(items: DataFrame, id_col: str, text_col: str, window: int, piece: int) -> DataFrame:
    """(item, n, words): the pieces of all items that have words, each with its words joined by spaces."""
    step = piece - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), bytes_of(batch), strict=True):
                held, first = [], True
                for chunk in words_of(text):
                    held += chunk
                    while len(held) > piece:
                        rows.append((item, piece, b" ".join(held[:piece])))
                        held, first = held[step:], False
                if held and (first or len(held) >= window):
                    rows.append((item, len(held), b" ".join(held)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["item", "n", "words"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "item string, n long, words binary").distinct()


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, piece: int = PIECE) -> tuple[DataFrame, int]:
    """(block, data): the packed automaton of each block of items, in the shared folder, and the number of blocks."""
    piece = max(piece, 2 * window)
    pieces = staged(pieces_of(items, id_col, text_col, window, piece), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // max(block_words, piece))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1))))
        most = dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(block_words, piece):
            break
        blocks *= 2

    def of_block(table: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        numbers: dict[bytes, int] = {}
        rows = sorted(zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True))
        held = [(names.setdefault(item, len(names)), [numbers.setdefault(w, len(numbers)) for w in words.split(b" ")]) for item, words in rows]
        data = pack(build(held, numbers, list(names), window))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    return staged(dealt.groupBy("block").applyInArrow(of_block, "block long, data binary"), "automata"), int(blocks)


def scan(docs: DataFrame, data: bytes | None, text_col: str) -> DataFrame:
    """docs with n_words, spans and items for one block, or none."""
    shared = docs.sparkSession.sparkContext.broadcast(data or pack(build([], {}, [], WINDOW)))  # bounded by block_words
    keep = [c for c in docs.columns if c != text_col]
    held: dict = {}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["a"] = unpack(shared.value)
        a = held["a"]
        for batch in slices(batches, name=text_col):
            counts, spans, items = [], [], []
            for text in bytes_of(batch, text_col):
                n, where, which = matches(words_of(text), a)
                counts.append(n)
                spans.append([{"start": s, "end": e} for s, e in where])
                items.append(sorted(a.names[i] for i in which))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=[*keep, "n_words", "spans", "items"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), FOUND])
    return docs.mapInArrow(stream, schema)


def united(spans: str) -> str:
    """SQL: sorted spans of several blocks, those that meet as one."""
    one = "if(size(a) > 0 and element_at(a, -1).end >= x.start, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))), concat(a, array(x)))"
    return f"aggregate(array_sort({spans}), cast(array() as array<struct<start:long,end:long>>), (a, x) -> {one})"


def find_spans(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS, piece: int = PIECE) -> DataFrame:
    """The columns to keep, n_words, spans of hit words (numbers from 0, end exclusive, ascending and apart) and items, for each row of docs."""
    bounded_batches(docs.sparkSession)
    found, blocks = automata(items, item_col, "text", window, block_words, piece)
    own = docs.select(*keep, F.col(text_col).cast("string").alias("text_"))
    get = lambda k: (lambda r: None if r is None else bytes(r[0]))(found.where(F.col("block") == k).select("data").first())
    if blocks <= 1:
        return scan(own, get(0), "text_")
    # several passes: rows get numbers of their own, and only those with hits go on
    rows = staged(own.withColumn("uid_", F.monotonically_increasing_id()), "rows")
    told, counts = None, None
    for k in range(blocks):
        data = get(k)
        if data is None:
            continue
        one = staged(scan(rows.select("uid_", "text_"), data, "text_"), f"pass-{k}")
        counts = counts or one.select("uid_", "n_words")
        hits = one.where("size(spans) > 0").select("uid_", "spans", "items")
        told = hits if told is None else told.unionByName(hits)
    both = told.groupBy("uid_").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row for each block at most
    both = both.select("uid_", F.expr(united("s")).alias("spans"), "items")
    whole = rows.drop("text_").join(counts, "uid_").join(both, "uid_", "left")
    return whole.select(*keep, "n_words", *(F.coalesce(F.col(c), F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("spans", "array<struct<start:long,end:long>>"), ("items", "array<string>"))))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; one space where something was taken out."""
    data = text.encode()
    places, out, at = WORD.finditer(data.translate(FOLD)), [], 0
    ends = iter(spans)
    span = next(ends, None)
    first = None
    for k, m in enumerate(places):
        if span is None:
            break
        if k == span[0]:
            first = m.start()
        if k == span[1] - 1:
            out.append(data[at:first].rstrip())
            at, span = m.end(), next(ends, None)
    out.append(data[at:].lstrip() if out else data[at:])
    return b" ".join(x for x in out if x).decode()


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", most_covered: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans in their texts; documents of which they cover more than a share of the words are dropped, others stay,
    with all their columns. chars_col, if it is there, gets the new length of a changed text."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col(f"`{text_col}`").alias("text"))
    told = find_spans(packed, items, ("row_",), "text", window=window, block_words=block_words)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = told.where(covered <= most_covered * F.col("n_words")).select("row_.*", F.col("spans").alias("spans_"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name=text_col):
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans_").to_pylist()]
            batch = batch.drop_columns(["spans_"])
            columns = list(batch.columns)
            if any(spans):
                old = batch.column(text_col).to_pylist()
                new = [without(t, s) if s else t for t, s in zip(old, spans, strict=True)]
                columns[names.index(text_col)] = pa.array(new, batch.column(text_col).type)
                if chars_col in names:
                    chars = batch.column(chars_col).to_pylist()
                    columns[names.index(chars_col)] = pa.array([len(t) if s else c for t, s, c in zip(new, spans, chars, strict=True)], batch.column(chars_col).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return left.mapInArrow(cut, docs.schema)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    told = find_spans(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return told.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
