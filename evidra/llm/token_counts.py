"""Token counts of whole texts with a sentencepiece model, by overlap resynchronisation.

Texts up to CHUNK characters go to the library whole. Longer ones are cut into chunks that overlap; each chunk is encoded with
offsets, and neighbours are spliced at a boundary that both have and that is proven stable: the character before it is not a
space and the one at it is, and no piece of the vocabulary holds a space after another character, so no merge can ever cross
it, whatever stands further left or right. (This is checked on the vocabulary once; a model with such a piece is encoded
whole.) Where an overlap has no such boundary it is widened, twofold each time, up to the whole rest of the text.

Null texts count as empty and have no token. Every input row gives one output row; ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.common import slices, texts_of

CHUNK, OVERLAP, LIMIT = 32_768, 256, 4096
SPACES = " ▁"


@lru_cache(4)
def load(path: str):
    """The model, and whether no piece holds a space after another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = SPACES[1]
    crossing = any(mark in p.lstrip(mark) for p in map(model.id_to_piece, range(model.get_piece_size())))
    return model, not crossing


def stable(text: str, at: int) -> bool:
    return text[at - 1] not in SPACES and text[at] in SPACES


def boundaries(model, chunk: str) -> np.ndarray:
    """Where the tokens of a chunk start, in characters; tokens within one character have the same start."""
    at = np.fromiter((p.begin for p in model.encode(chunk, return_type="proto").pieces), np.int64)  # in bytes of UTF-8
    leads = np.cumsum((np.frombuffer(chunk.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return leads[np.minimum(at, len(leads) - 1)] if len(at) else at


def starts(model, text: str, start: int, end: int) -> np.ndarray:
    """Where the tokens of text[start:end] start in the text. start is 0 or a stable boundary, whose space the library writes by
    itself before what it is given."""
    if start and end == start + 1:
        return np.array([start])
    lead = int(start > 0)
    return start + lead + boundaries(model, text[start + lead : end])


def count_tokens(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of the whole text, from overlapping chunks."""
    total, start, end = 0, 0, min(chunk, len(text))
    while True:
        at = starts(model, text, start, end)
        if end == len(text):
            return total + len(at)
        wide, cut = overlap, None
        while cut is None and wide < 2 * (end - start):
            low = max(start + 1, end - wide)
            following = low + boundaries(model, text[low : min(end + wide, len(text))])
            # near its ends a chunk may be cut into other tokens than the text is; a stable boundary isn't touched by that
            common = np.intersect1d(at, following)
            cut = next((int(x) for x in common[::-1] if low < x < end and stable(text, int(x))), None)
            wide *= 2
        if cut is None:  # no boundary in the whole chunk: take a longer one
            end = min(end + (end - start), len(text))
            continue
        total += int((at < cut).sum())
        start, end = cut, min(cut + chunk, len(text))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunked (1 if the text was cut) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, splits = load(model_path)
        for batch in slices(batches, 1 << 20):
            texts = texts_of(batch)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk or not splits]
            n = np.zeros(len(texts), np.int64)
            n[short] = [len(x) for x in model.encode([texts[i] for i in short], num_threads=1)]
            long = sorted(set(range(len(texts))) - set(short))
            for i in long:
                n[i] = count_tokens(model, texts[i], chunk, overlap)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            cut = np.zeros(len(texts), np.int64)
            cut[long] = 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit), pa.array(cut)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunked"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunked long"
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text").mapInArrow(run, schema)
