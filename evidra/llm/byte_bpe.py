"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are exploded with their positions in a compact form: a task's documents make chunks, a chunk numbers its different
pre-tokens, and a document becomes the list of their numbers. The different pre-tokens of all chunks are dealt to buckets by
hash, so each distinct one meets in one place and is encoded once; the ids are joined back by chunk and number, and documents
are reassembled by position. As words are distinct within a chunk before the shuffle, no word is hot. Decoding looks the ids of
a chunk's different words up in the table of token bytes, which each task holds (as large as the vocabulary), and puts their
bytes together by position.

Null texts count as empty. Every input row gives one output row; ids may be null or repeated. The pattern's white space is
spelled out, because libraries differ on the control characters 1C-1F.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from evidra.llm.common import n_partitions, shared_dir, slices, texts_of

CHUNK_BYTES = 24 << 20
#: Encoded words that a task holds; a bucket with more of them encodes some again.
MOST_KNOWN = 2_000_000
# The characters with the property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"


def spelled_out(pattern: str) -> str:
    """The pattern with \\s and \\S as explicit classes."""
    out = re.sub(r"\[\^\\s", lambda _: f"[^{_SPACE}", pattern)
    return out.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


@lru_cache(8)
def splitters(pattern: str):
    """For texts with other characters, and for ASCII texts."""
    spelled = spelled_out(pattern)
    ascii_only = spelled.replace(r"[\p{L}]", "[A-Za-z]").replace(_SPACE, r"\t-\r ")
    ascii_only = ascii_only.replace(r"[^\t-\r \p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return regex.compile(spelled, regex.V0), re.compile(ascii_only)


def pretokens(text: str, pattern: str) -> list[str]:
    wide, narrow = splitters(pattern)
    return (narrow if text.isascii() else wide).findall(text)


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in load_ranks(path).items()}


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of uint32, byte planes apart, compressed."""
    planes = [np.frombuffer(a.astype("<u4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    head = np.array([len(a) for a in arrays], "<u8").tobytes()
    return zstandard.compress(head + b"".join(planes), 3)


def stretch(data: bytes, k: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw[: 8 * k], "<u8")
    out, at = [], 8 * k
    for n in map(int, sizes):
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(n))
        at += 4 * n
    return out


def _joined(words: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(words), 3)


def split_chunks(docs: DataFrame, pattern: str, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """kind 0: a document with the numbers of its pre-tokens; kind 1: for a bucket, a chunk's numbers and pre-tokens."""
    schema = "kind int, chunk long, doc_id long, bucket int, numbers binary, words binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen, size = _Numbers(), 0

        def vocabulary() -> pa.RecordBatch:
            parts: dict[int, tuple[list[int], list[bytes]]] = {}
            for n, word in enumerate(seen):
                data = word.encode()
                a, b = parts.setdefault(zlib.crc32(data) % buckets, ([], []))
                a.append(n)
                b.append(data)
            rows = [(1, chunk, None, k, squeeze(np.array(a), np.array(list(map(len, b)))), _joined(b)) for k, (a, b) in parts.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types, strict=True)], names=names)

        for batch in slices(batches, 2 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = pretokens(text, pattern)
                rows.append((0, chunk, doc_id, None, squeeze(np.fromiter(map(seen.__getitem__, words), np.int64, len(words))), None))
                size += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
            if size >= chunk_bytes:
                yield vocabulary()
                seen, size, chunk = _Numbers(), 0, chunk + 1
        if seen:
            yield vocabulary()

    return docs.mapInArrow(run, schema)


def encode_words(vocabulary: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """chunk and, for a bucket's numbers, their ids. Each distinct word is encoded once: its bucket is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        at = None
        for batch in batches:
            for chunk, bucket, numbers, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "numbers", "words")), strict=True):
                if bucket != at or len(known) > MOST_KNOWN:
                    known, at = {}, bucket
                n, sizes = stretch(numbers, 2)
                data, start, ids, lengths = zstandard.decompress(words), 0, [], []
                for size in sizes.tolist():
                    word = data[start : start + size]
                    start += size
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word)
                    ids += got
                    lengths.append(len(got))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([squeeze(n, np.array(lengths), np.array(ids))], pa.binary())], names=["chunk", "ids"])

    parts = n_partitions(vocabulary.sparkSession)
    dealt = vocabulary.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.select("chunk", "bucket", "numbers", "words").mapInArrow(run, "chunk long, ids binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_words, and with keep_ids the ids themselves."""
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text")
    # files in the shared folder, bucketed by chunk: the documents' numbers are not shuffled again when their ids come back. Only a
    # table's description tells Spark of the buckets; it is read at once and leaves the catalog, the files stay.
    name = f"evidra_chunks_{uuid.uuid4().hex}"
    parts = split_chunks(rows, pattern, 2 * n_partitions(spark))
    parts.write.bucketBy(n_partitions(spark), "chunk").option("path", f"{shared_dir(spark)}/chunks").saveAsTable(name)
    both = spark.table(name)
    both.schema  # resolves the table
    spark.sql(f"drop table {name}")
    numbers = both.filter("kind = 0").select("chunk", "doc_id", "numbers")
    ids = encode_words(both.filter("kind = 1"), ranks_path, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long" + ", ids array<int>" * keep_ids

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table = token_bytes(ranks_path)
        found = [stretch(x, 3) for x in right.column("ids").to_pylist()]
        many = sum(len(n) for n, *_ in found)
        said, raw, sizes, own = [""] * many, [b""] * many, np.zeros(many, np.int64), [()] * (many if keep_ids else 0)
        for n, lengths, flat in found:
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            sizes[n] = lengths
            every, start = flat.tolist(), 0
            for k, end in zip(n.tolist(), ends, strict=True):
                word = every[start:end]
                start = end
                said[k] = " ".join(map(str, word))
                raw[k] = b"".join(map(table.__getitem__, word))
                if keep_ids:
                    own[k] = word
        out = []
        for doc_id, data in zip(left.column("doc_id").to_pylist(), left.column("numbers").to_pylist(), strict=True):
            (n,) = stretch(data, 1)
            at = n.tolist()
            text_ids = hashlib.sha256(" ".join(map(said.__getitem__, at)).encode()).hexdigest()
            decoded = hashlib.sha256(b"".join(map(raw.__getitem__, at))).hexdigest()
            out.append((doc_id, int(sizes[n].sum()), text_ids, decoded, len(at), *([[i for k in at for i in own[k]]] if keep_ids else [])))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return numbers.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(reassemble, schema)


def decode_ids(ids: list[int], ranks_path: str) -> bytes:
    table = token_bytes(ranks_path)
    return b"".join(table[i] for i in ids)
