"""De-duplication of repeated byte strings with suffix arrays that are built by Lyndon grouping.

``shared_windows`` routes text around shared anchors into blocks. Within a block, the pieces around each anchor form one text;
the suffix arrays of all these texts are built together (see ``suffix_groups``). Suffixes with a common prefix of ``length``
bytes are neighbours there; each such run tells the smallest document that holds the string, and the others lose it.

Null or empty texts have no bytes and lose none. Rows with a null id take no part. Extra columns are ignored. A kept byte
sequence may end within a UTF-8 character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, encoded, slices
from .hashing import byte_symbols
from .shared_windows import Piece, Windows, gathered, repeated_spans
from .suffix_groups import END, GUARD, suffix_arrays

_SEED = 20
_BATCH = 1 << 20
_SEPARATOR = 1


def _byte_slices(text: bytes, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(first.tolist(), end.tolist())]


def _texts(pieces: list[Piece]) -> list[tuple[int, int, int]]:
    """The pieces of each anchor as (symbols, first piece, end), longest texts last, so that texts that advance together are alike."""
    texts, at = [], 0
    for i in range(1, len(pieces) + 1):
        if i == len(pieces) or pieces[i].anchor != pieces[at].anchor:
            texts.append((sum(len(p.data) + 1 for p in pieces[at:i]) + 1, at, i))
            at = i
    return sorted(texts)


def _batches(texts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    batch, size = [], 0
    for text in texts:
        if batch and size + text[0] > _BATCH:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += text[0]
    if batch:
        yield batch


def _repeats(pieces: list[Piece], texts: list[tuple[int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and first byte of every window that a smaller document also holds."""
    size = np.array([t[0] for t in texts], dtype=np.int64)
    base = np.cumsum(size) - size
    own = [p for _, a, b in texts for p in pieces[a:b]]
    symbols = np.zeros(size.sum(), dtype=np.int16)
    symbols[base] = GUARD
    lengths = np.array([len(p.data) for p in own], dtype=np.int64)
    in_text = np.repeat(np.arange(len(texts)), [b - a for _, a, b in texts])
    # A text is a guard, then its pieces, each with one symbol after it: a separator, or the end after the last.
    start = np.cumsum(lengths + 1) - (lengths + 1) + in_text + 1
    raw = np.frombuffer(b"".join(p.data for p in own), dtype=np.uint8).astype(np.int16) + 2
    symbols[np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(raw))] = raw
    symbols[start + lengths] = _SEPARATOR
    symbols[base + size - 1] = END
    order = suffix_arrays(symbols, base, size - 1)
    windows = np.array([p.windows for p in own], dtype=np.int64)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(start, windows) + offset
    piece_at = np.full(len(symbols), -1, dtype=np.int32)
    piece_at[at] = np.repeat(np.arange(len(own), dtype=np.int32), windows)
    order = order[piece_at[order] >= 0]
    piece = piece_at[order]
    strings = np.lib.stride_tricks.sliding_window_view(symbols, length)
    same = np.zeros(len(order), dtype=bool)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        same[a:b] = (strings[order[a:b]] == strings[order[a - 1 : b - 1]]).all(axis=1)
    same[1:] &= in_text[piece[1:]] == in_text[piece[:-1]]
    doc = np.array([p.doc for p in own], dtype=np.int64)[piece]
    runs = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc, runs) if len(runs) else doc
    later = doc > np.repeat(least, np.diff(np.append(runs, len(doc))))
    first = np.array([p.first for p in own], dtype=np.int64)[piece] + order - start[piece]
    return doc[later], first[later]


def _solve(length: int):
    def run(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [_repeats(pieces, batch, length) for batch in _batches(_texts(pieces))]
        doc, first = (np.concatenate(x) for x in zip(*found))
        return doc, first, first + length

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc, text, blobs in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), batch.column("spans").to_pylist()):
            start, end = gathered(blobs)
            kept, at = [], 0
            for a, b in zip(start.tolist(), end.tolist()):
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            kept = b"".join(kept)
            rows.append((doc, len(text), len(text) - len(kept), len(start), kept))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=list(names))


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes of strings of ``length`` bytes that a document with a smaller id also holds.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the remaining bytes).
    """
    own = documents(docs, id_col, text_col)
    kind = Windows(length, min(_SEED, length), byte_symbols, _byte_slices, _solve(length))
    spans = repeated_spans(own, kind)
    return own.join(spans, "doc_id", "left").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """The digest columns of :func:`without_repeats`."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
