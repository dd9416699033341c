"""Which windows of a document also start in a document with a smaller id, over the whole corpus.

Comparing all windows would shuffle one row per word or byte. Instead every window belongs to an anchor (see
``anchors``), and one packed entry per range of windows goes to the bucket of its anchor:

1. ``_entries`` (per slice of a batch of documents): ranges of windows with their anchor and a hash of what they cover. Of equal
   ranges in one slice, only the first document's travel, each of them; the others are decided at once. So a passage that a third of
   all documents share sends one entry per slice, and more only if its first document repeats it.
2. ``_decide`` (per bucket): a range that covers the same symbols as one of a smaller document is decided. Ranges that share
   their anchor with others, but not all of their symbols, stay open: the ends of shared passages.
3. ``_cut`` (joined to the documents by id): the text of the open ranges, keyed by anchor.
4. ``solve`` (per block of anchors): the operator's own method finds the windows that open pieces share. Where an anchor
   has more than ``WIDE`` different ranges, or ``MANY`` ranges with the repeats within documents, pieces would meet in one
   group without bound. Their windows are dealt out by the hash of each window instead, and the smallest document per window is
   found there (exact up to 128-bit hashes).
5. The spans of each document are gathered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import SLICE_BYTES, bucket_count, by_bucket, encoded, merged_spans, pack, slices, text_bytes, unpack, unpacked
from .hashing import Runs

WIDE = 64
MANY = 16 * WIDE
#: An entry: 40 bits of the anchor's hash beside its bucket (a clash only puts two anchors into one group), 56 bits of the
#: hash of what is covered (compared within an anchor only), document, first and last window.
_ENTRY = (5, 7, "i8", "i4", "i4")
_RANGE = ("i8", "i4", "i4")
_WINDOW = (8, 8, "i8", "i4")
_SPAN = ("i4", "i4")
_DECIDED, _PIECE, _WINDOWS = 0, 1, 2
_DECISIONS = "doc_id long, first int, last int, anchor long, kind int"
_OPEN = (8, "i8", "i4", "i4", "i4")
_CUT = "block int, kind int, doc_id long, data binary, text binary"


class Piece(NamedTuple):
    """Symbols around an anchor: ``windows`` windows that start at 0, 1, ... of ``data``."""

    anchor: int
    doc: int
    first: int
    windows: int
    data: bytes


class Windows(NamedTuple):
    """What differs between words and bytes. Functions must be importable by name.

    ``symbols``: text to 64-bit symbols. ``slices``: text and spans of symbols to the bytes that hold them.
    ``solve``: pieces of one block, all of an anchor together, to arrays (doc, start, end) of spans that repeat a smaller document.
    """

    length: int
    seed: int
    symbols: Callable[[bytes], np.ndarray]
    slices: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    solve: Callable[[list[Piece]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks the rows of sorted columns where any of them changes."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _folded(anchor, whole, doc, first) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order, and the marks of the first document for each pair of anchor and covered symbols."""
    order = np.lexsort((first, doc, whole, anchor))
    return order, _firsts(anchor[order], whole[order])


def _entries(kind: Windows, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            parts = [[], [], [], [], []]
            for doc, text in zip(ids, encoded(batch.column("text"))):
                if doc is None:
                    continue
                found = anchors(kind.symbols(text), kind.length, kind.seed)
                if len(found[0]):
                    for part, column in zip(parts, (found[0], found[1], np.full(len(found[0]), doc), *found[2:])):
                        part.append(column)
            if not parts[0]:
                continue
            anchor, whole, doc, first, last = (np.concatenate(p) for p in parts)
            order, new = _folded(anchor, whole, doc, first)
            least = doc[order][new][np.cumsum(new) - 1]
            decided = np.sort(order[doc[order] > least])
            sent = np.sort(order[doc[order] == least])
            rows = []
            for bucket, own in by_bucket((anchor[sent] % np.uint64(buckets)).astype(np.int64)):
                own = sent[own]
                rows.append((bucket, pack(_ENTRY, anchor[own] >> np.uint64(24), whole[own], doc[own], first[own], last[own])))
            # Decided ranges travel apart, to buckets below zero, without their hashes.
            for bucket, own in by_bucket(doc[decided] % buckets):
                own = decided[own]
                rows.append((-1 - bucket, pack(_RANGE, doc[own], first[own], last[own])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return run


def _decisions(doc, first, last, anchor, kind) -> pa.Table:
    return pa.table({
        "doc_id": pa.array(doc, pa.int64()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()),
        "anchor": pa.array(anchor.view("i8"), pa.int64()), "kind": pa.array(kind, pa.int32()),
    })


def _decide(key, group):
    blobs = group.column("blob").to_pylist()
    if key[0].as_py() < 0:
        doc, first, last = unpacked(_RANGE, blobs)
        return _decisions(doc, first, last, np.zeros(len(doc), "u8"), np.zeros(len(doc), "i4"))
    anchor, whole, doc, first, last = unpacked(_ENTRY, blobs)
    order, new = _folded(anchor, whole, doc, first)
    anchor, doc, first, last = anchor[order], doc[order], first[order], last[order]
    least = doc[new][np.cumsum(new) - 1]
    starts = np.flatnonzero(_firsts(anchor))
    group_of = np.cumsum(_firsts(anchor)) - 1
    shared = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
    different = np.add.reduceat(new.astype(np.int64), starts)
    first_doc = doc == least  # it may hold a range more than once, and each may share its ends with a smaller document
    rows = np.add.reduceat(first_doc.astype(np.int64), starts)
    state = np.full(len(doc), -1)
    state[first_doc & (shared & (different > 1))[group_of]] = _PIECE
    state[(state == _PIECE) & ((different > WIDE) | (rows > MANY))[group_of]] = _WINDOWS
    state[doc > least] = _DECIDED
    kept = state >= 0
    return _decisions(doc[kept], first[kept], last[kept], anchor[kept], state[kept])


def _cut(kind: Windows, blocks: int):
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary()), ("text", pa.binary())])
    tail = kind.length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE_BYTES):
            rows, open_windows, pieces, places = [], [], [], []
            texts = encoded(batch.column("text"))
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), texts, batch.column("ranges")):
                if not found.is_valid:
                    continue
                ranges = found.values.flatten()
                first, last, anchor, state = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges)
                start, end = merged_spans(first[state == _DECIDED], last[state == _DECIDED] + 1 + tail)
                if len(start):
                    rows.append((doc % blocks, _DECIDED, doc, pack(_SPAN, start, end), None))
                piece = np.flatnonzero(state == _PIECE)
                if len(piece):
                    pieces += kind.slices(text, first[piece], last[piece] + 1 + tail)
                    places.append((anchor[piece], np.full(len(piece), doc), first[piece], last[piece] - first[piece] + 1))
                wide = np.flatnonzero(state == _WINDOWS)
                if len(wide):
                    hashes = Runs(kind.symbols(text)).all(kind.length)
                    for i in wide.tolist():
                        span = hashes[first[i] : last[i] + 1]
                        open_windows.append((np.full(len(span), anchor[i]).view("u8"), span, np.full(len(span), doc), np.arange(first[i], last[i] + 1, dtype="i4")))
            if open_windows:
                anchor, window, doc, first = (np.concatenate(x) for x in zip(*open_windows))
                for block, own in by_bucket((window % np.uint64(blocks)).astype(np.int64)):
                    rows.append((block, _WINDOWS, None, pack(_WINDOW, anchor[own], window[own], doc[own], first[own]), None))
            if pieces:
                anchor, doc, first, windows = (np.concatenate(x) for x in zip(*places))
                lengths = np.array([len(x) for x in pieces])
                for block, own in by_bucket(anchor % blocks):
                    text = b"".join(pieces[i] for i in own.tolist())
                    rows.append((block, _PIECE, None, pack(_OPEN, anchor[own], doc[own], first[own], windows[own], lengths[own]), pa.compress(text, codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run


def _solve(kind: Windows):
    def run(key, group):
        states = group.column("kind").to_numpy()
        data = group.column("data")
        spans = []
        for doc, blob in zip(group.column("doc_id").filter(pa.array(states == _DECIDED)).to_pylist(), data.filter(pa.array(states == _DECIDED)).to_pylist()):
            start, end = unpack(_SPAN, blob)
            spans.append((np.full(len(start), doc), start, end))
        blobs = data.filter(pa.array(states == _WINDOWS)).to_pylist()
        if blobs:
            anchor, window, doc, first = unpacked(_WINDOW, blobs)
            order, new = _folded(anchor, window, doc, first)
            doc, first = doc[order], first[order]
            later = doc > doc[new][np.cumsum(new) - 1]
            spans.append((doc[later], first[later], first[later] + kind.length))
        chosen = pa.array(states == _PIECE)
        pieces = []
        for blob, text in zip(data.filter(chosen).to_pylist(), group.column("text").filter(chosen).to_pylist()):
            anchor, doc, first, windows, lengths = unpack(_OPEN, blob)
            ends = np.cumsum(lengths)
            text = pa.decompress(text, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
            parts = (text[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist()))
            pieces += map(Piece._make, zip(anchor.tolist(), doc.tolist(), first.tolist(), windows.tolist(), parts))
        if pieces:
            spans.append(kind.solve(sorted(pieces)))
        doc, start, end = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, "i8"),) * 3
        ids, out = [], []
        for own_rows in (rows for _, rows in by_bucket(doc)):
            found = merged_spans(start[own_rows], end[own_rows])
            ids.append(int(doc[own_rows[0]]))
            out.append(pack(_SPAN, *found))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "spans": pa.array(out, pa.binary())})

    return run


def repeated_spans(docs: DataFrame, kind: Windows) -> DataFrame:
    """Per document that has any: ``doc_id``, ``spans`` (list of packed span lists, see :func:`gathered`).

    ``docs`` has ``doc_id`` (distinct; null rows take no part) and ``text`` (null counts as empty).
    """
    buckets = bucket_count(text_bytes(docs))
    entries = docs.mapInArrow(_entries(kind, buckets), "bucket int, blob binary")
    decided = entries.groupBy("bucket").applyInArrow(_decide, _DECISIONS)
    ranges = decided.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "anchor", "kind")).alias("ranges"))
    # A left join here, as in the callers' last step, lets both read one shuffle of the texts.
    cut = docs.join(ranges, "doc_id", "left").mapInArrow(_cut(kind, buckets), _CUT)
    solved = cut.groupBy("block").applyInArrow(_solve(kind), "doc_id long, spans binary")
    return solved.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def gathered(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """The spans of one document as maximal runs."""
    if not blobs:
        return np.zeros(0, "i4"), np.zeros(0, "i4")
    start, end = unpacked(_SPAN, blobs)
    return merged_spans(start, end)
