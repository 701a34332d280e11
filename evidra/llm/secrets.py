"""Secret scans with a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regex (parsed with the regex parser of the standard library):
every match must contain the trigrams of a literal run, runs in sequence are joined by AND, branches by OR. Documents are
indexed in segments (some of the rows that a task reads): a segment's index is made from the texts alone, before any rule is
looked at, and holds for every trigram of bytes that occurs (A-Z lower-cased) the ascending list of texts that contain it.
Intersecting and uniting these postings gives the candidates, and only these are verified with the regex, over their whole
texts. A rule whose regex has no mandatory trigram scans every document.

`index_documents` gives the segments as rows (texts, trigrams, postings) that can be written to shared files, and `scan_index`
searches them with any rules, as often as wanted. `scan_secrets` and `redact_secrets` need one search only, so they index and
search a segment in the task that reads it: nothing is written or shuffled, and a lost executor costs its own tasks.

Null texts count as empty; ids may be null or repeated; every input row gives one output row; an empty table gives none. Other
columns are ignored, and `redact_secrets` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from evidra.llm.common import bounded_batches, slices, texts_of

# The rules. kind, pattern, group whose length counts, least length of that group. The first three are the base.
BASE_RULES = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{30,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"

#: Bytes of the texts of a segment, beyond its last one.
SEGMENT_BYTES = 2 << 20

Query = tuple  # ("all",) | ("tri", trigram) | ("and", queries) | ("or", queries)
ALL: Query = ("all",)


def _both(parts: list[Query]) -> Query:
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list[Query]) -> Query:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _low(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _strings(items: list, most: int = 64) -> list[set[str]]:
    """For each item of a parsed sequence, the lower-cased strings it may match, or none if they can't be listed."""
    out: list[set[str] | None] = []
    for op, arg in items:
        if op is rc.LITERAL:
            out.append({_low(arg)})
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len({_low(a) for _, a in arg}) <= 8:
            out.append({_low(a) for _, a in arg})
        elif op is rc.SUBPATTERN:
            found = _listed(arg[-1], most)
            out.append(found)
        elif op is rc.BRANCH:
            lists = [_listed(x, most) for x in arg[1]]
            out.append(set().union(*lists) if all(x is not None for x in lists) else None)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 1:
            found = _listed(arg[2], most)
            out.append(None if found is None else found | {""} if arg[0] == 0 else found)
        else:
            out.append(None)
    return out  # type: ignore[return-value]


def _listed(items: list, most: int) -> set[str] | None:
    found = {""}
    for part in _strings(items, most):
        if part is None or len(found) * len(part) > most:
            return None
        found = {a + b for a in found for b in part}
    return found


def _of_strings(found: set[str]) -> Query:
    """Some string of these occurs: for each, all its trigrams. A set that holds another one adds nothing."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in found}
    least = [x for x in sets if not any(y < x for y in sets)]
    return _either([_both([("tri", t) for t in sorted(x)]) for x in sorted(least, key=sorted)])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """A query over lower-cased trigrams that every text with a match of the pattern satisfies."""

    def of(items: list) -> Query:
        parts: list[Query] = []
        run = {""}
        for (op, arg), strings in zip(items, _strings(items, most), strict=True):
            if strings is not None and len(run) * len(strings) <= most:
                run = {a + b for a in run for b in strings}
                continue
            parts.append(_of_strings(run))
            run = {""} if strings is None else strings
            if strings is None:
                if op is rc.SUBPATTERN:
                    parts.append(of(arg[-1]))
                elif op is rc.BRANCH:
                    parts.append(_either([of(x) for x in arg[1]]))
                elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                    parts.append(of(arg[2]))
        return _both([*parts, _of_strings(run)])

    return of(list(rp.parse(pattern)))


def trigrams_in(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set() if query == ALL else set().union(*map(trigrams_in, query[1]))


@dataclass
class Segment:
    """An inverted index: ascending trigrams, where their postings start, and the numbers of the texts, ascending in each."""

    trigrams: np.ndarray
    starts: np.ndarray
    texts: np.ndarray

    def of_trigram(self, trigram: bytes) -> np.ndarray:
        code = np.uint32(int.from_bytes(trigram, "big"))
        k = int(np.searchsorted(self.trigrams, code))
        if k == len(self.trigrams) or self.trigrams[k] != code:
            return self.texts[:0]
        return self.texts[self.starts[k] : self.starts[k + 1]]

    def of_string(self, string: str) -> np.ndarray:
        """Texts that have all byte trigrams of a string of three characters."""
        data = string.encode()
        found = [self.of_trigram(data[i : i + 3]) for i in range(len(data) - 2)]
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(found, key=len))


def _codes(b: np.ndarray) -> np.ndarray:
    wide = b.astype(np.uint32)
    return wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]


def segment_of(texts: list[bytes], block: int = 1 << 20) -> Segment:
    """The index of some texts in UTF-8, any number of them. Beside the texts it takes memory for a block of them."""
    found, group, size = [], [], 0

    def add() -> None:
        """Sorted pairs of a trigram and a text, each once; trigrams that reach from one text into the next are left out."""
        lengths = np.array([len(x) for _, x in group])
        b = np.frombuffer(b"".join(x for _, x in group), np.uint8)
        if len(b) > 2:
            owner = np.repeat(np.array([k for k, _ in group], np.uint64), lengths)
            whole = np.ones(len(b) - 2, bool)
            ends = np.cumsum(lengths)[:-1]
            for back in (1, 2):
                at = ends - back
                whole[at[(at >= 0) & (at < len(whole))]] = False
            pairs = np.sort((_codes(b).astype(np.uint64) << np.uint64(32) | owner[: len(b) - 2])[whole])
            found.append(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs)

    for k, text in enumerate(texts):
        low = text.lower()
        for start in range(0, max(len(low) - 2, 1), block):  # blocks of a long text overlap by two bytes
            group.append((k, low[start : start + block + 2]))
            size += len(group[-1][1])
            if size >= block:
                add()
                group, size = [], 0
    if group:
        add()
    pairs = np.concatenate(found) if found else np.empty(0, np.uint64)
    if len(found) > 1:
        pairs = np.unique(pairs)
    code = (pairs >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return Segment(code[first], np.r_[first, len(code)], (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))


def candidates(query: Query, segment: Segment, n: int) -> np.ndarray:
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return segment.of_string(query[1])
    parts = sorted((candidates(q, segment, n) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def matches(pattern: re.Pattern, group: int, least: int, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those whose group is too short are dropped afterwards."""
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def find_spans(texts: list[str], rules: tuple = RULES, segment: Segment | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text of a segment, its spans (kind number, start, end) by start, then kind as listed."""
    segment = segment_of([t.encode() for t in texts]) if segment is None else segment
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (pattern, group, least, query) in enumerate(_compiled(rules)):
        for i in candidates(query, segment, len(texts)).tolist():
            out[i] += [(start, k, end) for start, end in matches(pattern, group, least, texts[i])]
    return [[(k, start, end) for start, k, end in sorted(x)] for x in out]


_CACHE: dict = {}


def _compiled(rules: tuple) -> list:
    if rules not in _CACHE:
        _CACHE[rules] = [(re.compile(p), group, least, trigram_query(p)) for _, p, group, least in rules]
    return _CACHE[rules]


def _told(ids: list, spans: list[list[tuple[int, int, int]]], rules: tuple) -> pa.RecordBatch:
    base, kinds, rows = len(BASE_RULES), [r[0] for r in rules], []
    for doc_id, found in zip(ids, spans, strict=True):
        said = [(k, f"{kinds[k]}:{start}:{end}") for k, start, end in found]
        digest = hashlib.sha256(",".join(s for k, s in said if k < base).encode()).hexdigest()
        rows.append((doc_id, *(sum(k == b for k, *_ in found) for b in range(base)), digest, ",".join(s for _, s in said), len(said)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES, strict=True)], names=_NAMES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as kind:start:end (code points)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEGMENT_BYTES):
            yield _told(batch.column("doc_id").to_pylist(), find_spans(texts_of(batch), rules), rules)

    return _rows(docs, id_col, text_col).mapInArrow(scan, SCHEMA)


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment: ids, texts, and its index (trigrams as differences, sizes of the postings, numbers of the texts)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEGMENT_BYTES):
            texts = texts_of(batch)
            x = segment_of([t.encode() for t in texts])
            parts = [np.diff(x.trigrams, prepend=np.uint32(0)).astype("<u4"), np.diff(x.starts).astype("<u4"), x.texts.astype("<u4")]
            packed = [pa.array([zstandard.compress(a.tobytes(), 3)], pa.binary()) for a in parts]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), *packed], names=["ids", "texts", "trigrams", "sizes", "postings"])

    return _rows(docs, id_col, text_col).mapInArrow(build, "ids array<long>, texts array<string>, trigrams binary, sizes binary, postings binary")


def scan_index(index: DataFrame, rules: tuple = RULES) -> DataFrame:
    """What scan_secrets gives, from the segments of index_documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, *packed in zip(*(batch.column(c).to_pylist() for c in ("ids", "texts", "trigrams", "sizes", "postings")), strict=True):
                a, n, t = (np.frombuffer(zstandard.decompress(x), kind) for x, kind in zip(packed, ("<u4", "<u4", "<u4"), strict=True))
                segment = Segment(np.cumsum(a, dtype=np.uint32), np.r_[0, np.cumsum(n, dtype=np.int64)], t.astype(np.int64))
                yield _told(ids, find_spans(texts, rules, segment), rules)

    return index.mapInArrow(scan, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple = RULES) -> str:
    """The text with each secret replaced by the name of its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for k, start, end in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{rules[k][0]}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: tuple = RULES) -> DataFrame:
    """docs with the secrets in their texts replaced; rows without one are unchanged, and none is dropped.

    chars_col, if it is there, gets the new length of a changed text."""
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEGMENT_BYTES, text_col):
            texts = texts_of(batch, text_col)
            new = [redact(t, s, rules) if s else None for t, s in zip(texts, find_spans(texts, rules), strict=True)]
            columns = list(batch.columns)
            if any(x is not None for x in new):
                old = columns[at].to_pylist()
                columns[at] = pa.array([o if n is None else n for o, n in zip(old, new, strict=True)], columns[at].type)
                if chars is not None:
                    columns[chars] = pa.array([o if n is None else len(n) for o, n in zip(columns[chars].to_pylist(), new, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(clean, docs.schema)
