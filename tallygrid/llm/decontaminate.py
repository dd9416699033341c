"""Benchmark decontamination by spaced seeds.

A token is a run of letters, digits and non-ASCII characters, A-Z in lower case. Every fixed mask picks some tokens out of a stretch and
ignores the others, so a stretch still hits where an ignored token was replaced. The masks below hit every overlap that counts,
whatever its length and wherever its replaced tokens are (for ``least_tokens`` of 8 or more). The hashes of the test items are joined to those of the
documents; each hit fixes an alignment, along which the overlap is grown token by token over single replaced tokens, until two in a
row differ. An overlap counts if at least ``least_tokens`` of its tokens agree (or 75 % of a shorter item, 8 at least) and these are at
least 75 % of its length.

Test items are indexed in blocks of bounded size; every block is one pass over the documents, so a task holds one block and the
documents are never shuffled. Items of fewer than 8 tokens are too short to tell and match nothing. Null or empty texts, on either side,
match nothing. Null ids are kept as null. Rows that repeat an id are reported together. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, encoded
from .hashing import mix, word_hashes

MASKS = ("110101011", "10110111", "11101101", "1010101011", "1101111")
LEAST_ITEM = 8
LEAST_TOKENS = 13
AGREEMENT = 0.75
#: Bytes of test texts in one block.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 24
_FOUND = "doc_id long, item_id long, doc_first int, item_first int, n_tokens int, n_agree int"

_TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: bytes) -> np.ndarray:
    """The hashes of a text's tokens."""
    return word_hashes(text.translate(_TOKEN_BYTES))[0]


def seeds(symbols: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the picked tokens of every stretch of the mask's length."""
    count = len(symbols) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, number + 1, dtype=np.uint64)
    for place, picked in enumerate(mask):
        if picked == "1":
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += symbols[place : place + count]
    return mix(total)


def overlap(one: np.ndarray, other: np.ndarray, at: int) -> tuple[int, int, int]:
    """The overlap of two aligned stretches around a place: first, end, tokens that agree."""
    same = one == other
    # Two differing tokens in a row (or the end of a stretch) end the overlap; what it ends with must agree.
    stops = np.flatnonzero(~same[:-1] & ~same[1:]) if len(same) > 1 else np.zeros(0, dtype=np.int64)
    before, after = stops[stops < at], stops[stops >= at]
    first = int(before[-1]) + 2 if len(before) else 0
    end = int(after[0]) if len(after) else len(same)
    agree = np.flatnonzero(same[first:end])
    if not len(agree):
        return at, at, 0
    return first + int(agree[0]), first + int(agree[-1]) + 1, len(agree)


class _Index:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, bytes]], least: int):
        self.least = least
        self.items = [(i, tokens(text)) for i, text in items]
        parts = []
        for place, (_, symbols) in enumerate(self.items):
            if len(symbols) < LEAST_ITEM:
                continue
            for number, mask in enumerate(MASKS):
                found = seeds(symbols, mask, number)
                parts.append((found, np.full(len(found), place), np.arange(len(found))))
        seed, place, offset = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, "u8"),) * 3
        order = np.argsort(seed, kind="stable")
        self.seed, self.place, self.offset = seed[order], place[order], offset[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seed & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def overlaps(self, symbols: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Item place, first token in the text, first in the item, length, agreeing tokens; distinct."""
        alignments: dict[tuple[int, int], list[int]] = {}
        for number, mask in enumerate(MASKS):
            found = seeds(symbols, mask, number)
            likely = np.flatnonzero(self.filter[found & np.uint64((1 << _FILTER_BITS) - 1)])
            low, high = np.searchsorted(self.seed, found[likely]), np.searchsorted(self.seed, found[likely], side="right")
            for at, a, b in zip(likely.tolist(), low.tolist(), high.tolist()):
                for k in range(a, b):
                    offset = int(self.offset[k])
                    alignments.setdefault((int(self.place[k]), at - offset), []).append(offset)
        out = set()
        for (place, shift), offsets in alignments.items():
            item = self.items[place][1]
            first, end = max(0, -shift), min(len(item), len(symbols) - shift)
            reached = -1
            for offset in sorted(offsets):
                if offset < reached:
                    continue  # within the overlap just found
                a, b, agree = overlap(item[first:end], symbols[first + shift : end + shift], offset - first)
                reached = first + b
                needed = min(self.least, max(LEAST_ITEM, int(np.ceil(AGREEMENT * len(item)))))
                if agree >= needed and agree >= AGREEMENT * (b - a):
                    out.add((place, first + a + shift, first + a, b - a, agree))
        return sorted(out)


def _search(items: list[tuple[int, bytes]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(items, least)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"))):
                symbols = tokens(text)
                rows += [(doc, index.items[p][0], a, b, n, k) for p, a, b, n, k in index.overlaps(symbols)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "item_id", "doc_first", "item_first", "n_tokens", "n_agree"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The test items in blocks of bounded size, one at a time."""
    block, size = [], 0
    for row in benchmark.filter("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"].encode()))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every verified overlap: ``doc_id``, ``item_id``, ``doc_first``, ``item_first`` (tokens), ``n_tokens``, ``n_agree``."""
    own = documents(docs, id_col, text_col)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    found = [own.mapInArrow(_search(block, least_tokens), _FOUND) for block in _blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _FOUND)


def contaminated(found: DataFrame) -> DataFrame:
    """Per document with an overlap: ``doc_id``, ``n_items``, ``n_overlaps``, ``longest`` (agreeing tokens), ``items`` (ascending)."""
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_overlaps"), F.max("n_agree").alias("longest"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )


def _keep(items: list[tuple[int, bytes]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(items, least)
        for batch in batches:
            clean = [not index.overlaps(tokens(text)) for text in encoded(batch.column("text"))]
            yield batch.select([0]).filter(pa.array(clean, pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no overlap with any item."""
    from pyspark.sql.types import StructType

    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    kept = docs
    for block in _blocks(items):
        packed = kept.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
        kept = packed.mapInArrow(_keep(block, least_tokens), StructType([packed.schema["row"]])).select("row.*")
    return kept
