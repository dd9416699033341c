"""Substring de-duplication by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks: the text that documents with smaller ids hold around the same anchors (see
``shared_windows``, which routes text to the blocks that can share a window with it, and to no others). The blocks are
indexed by windows. A piece is factored greedily from left to right: where an indexed window starts, the factor is
extended along its source as far as both agree; elsewhere one word is a literal. A factor of at least the window length is
a repeated span. A repeat may begin inside a factor and go on beyond its end where another source takes over, so
after each factor the parse resumes at the first window that crosses the factor's end.

Null or empty texts have no words and lose none. Rows with a null id take no part. Ties cannot occur: ids are distinct.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, encoded, slices
from .hashing import word_hashes
from .shared_windows import Piece, Windows, gathered, repeated_spans

_SEED = 16


def _words(text: bytes) -> np.ndarray:
    return word_hashes(text)[0]


def _word_slices(text: bytes, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    if not len(first):
        return []
    _, starts, ends = word_hashes(text)
    return [text[a:b] for a, b in zip(starts[first].tolist(), ends[end - 1].tolist())]


def parse(words: list[bytes], index: dict, references: list[list[bytes]], length: int) -> list[tuple[int, int]]:
    """The long factors of a piece: spans of ``words`` whose windows are all indexed.

    ``index`` maps a window (a tuple of words) to its place (reference, offset) in ``references``.
    """
    spans = []
    at, last = 0, len(words) - length
    while at <= last:
        source = index.get(tuple(words[at : at + length]))
        if source is None:
            at += 1  # a literal
            continue
        reference, offset = references[source[0]], source[1]
        end, other = at + length, offset + length
        while end < len(words) and other < len(reference) and words[end] == reference[other]:
            end, other = end + 1, other + 1
        spans.append((at, end))
        at = end - length + 1  # the first window that crosses the factor's end
    return spans


def _solve(length: int):
    def run(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for _, group in groupby(pieces, key=lambda p: p.anchor):
            index: dict = {}
            references: list[list[bytes]] = []
            for _, same in groupby(group, key=lambda p: p.doc):
                same = [(p, p.data.split()) for p in same]
                for piece, words in same:
                    found.extend((piece.doc, piece.first + a, piece.first + b) for a, b in parse(words, index, references, length))
                for piece, words in same:  # a document is no reference for itself
                    references.append(words)
                    for i in range(piece.windows):
                        index.setdefault(tuple(words[i : i + length]), (len(references) - 1, i))
        columns = np.array(found, dtype=np.int64).reshape(-1, 3)
        return columns[:, 0], columns[:, 1], columns[:, 2]

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc, text, blobs in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), batch.column("spans").to_pylist()):
            words = text.split()
            start, end = gathered(blobs)
            kept, at = [], 0
            for a, b in zip(start.tolist(), end.tolist()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((doc, len(words), len(words) - len(kept), len(start), b" ".join(kept).decode()))
        names = ("doc_id", "n_words", "n_removed", "n_spans", "kept_text")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=list(names))


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words of windows that a document with a smaller id also holds.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_text`` (the kept words joined by one space).
    """
    own = documents(docs, id_col, text_col)
    kind = Windows(length, min(_SEED, length), _words, _word_slices, _solve(length))
    spans = repeated_spans(own, kind)
    return own.join(spans, "doc_id", "left").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, n_spans long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    """The digest columns of :func:`without_repeats`."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
