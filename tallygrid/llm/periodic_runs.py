"""Periodic runs of words: maximal stretches that repeat their own beginning, and texts without the repetitions.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) that cannot be extended on either side and has at least
``least`` words and ``exponent`` periods. Every run has a Lyndon root: for one of the two orders of the words, the longest Lyndon word that starts at some
place inside the run is one period of it. So the longest Lyndon words of all places, under both orders, are the candidates, two per word.

1. Ukkonen trees of the text and of its reversal. The order of the leaves gives the order of the suffixes; the longest Lyndon word at a place
   ends where the next smaller suffix starts.
2. Euler tours over the string depths of both trees; the least depth between two leaves is how far their suffixes agree. Range minima in
   constant time: a sparse table over blocks, and minima from and to block borders.
3. Each candidate ``[i, j)`` is extended: to the right by the agreement of the suffixes at ``i`` and ``j``, to the left by that of the reversed text.
   What is long enough is a run; several candidates give the same one.

Trees are only built over the places that can lie in a run. In a run of period ``q``, each three words from the second period on stand ``q`` places
earlier too. So where the distance to the previous equal triple stays within ``q`` for fewer than ``(exponent - 1) q - 2`` places, no run of that period
is. This is tested for all periods at once, by powers of two; the stretches left, with a period before and two words after, contain every run whole,
and a stretch never holds a part of a run only, because stretches that share a word are one. Hash collisions among triples add stretches, never lose one.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; null, empty and blank texts have no words and no runs. Texts are worked on whole; memory grows
with the longest text and with its longest stretch (about half a kilobyte per word). Rows are independent: repeated ids and rows give a row each, a null
id is kept. Further columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import encoded, merged_spans, slices

LEAST = 6
EXPONENT = 4
_SLICE = 4 << 20
_BLOCK = 16
#: Multipliers that mix three word numbers and a document number into a hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class SuffixTree:
    """Ukkonen's tree of a list of numbers above 0; a closing 0 is added, so every suffix ends in a leaf."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self._size = size = len(text)
        width = max(text) + 1
        start, stop, link, suffix = [0], [0], [0], [-1]
        edges: dict[int, int] = {}
        node = edge = length = waiting = leaves = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(size)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = start[child]
                    span = stop[child] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    start += (first, i)
                    stop += (first + length, size)
                    link += (0, 0)
                    suffix += (-1, leaves)
                    leaves += 1
                    edges[key] = split
                    edges[split * width + symbol] = split + 1
                    start[child] = first + length
                    edges[split * width + text[first + length]] = child
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._span = (np.array(stop) - np.array(start)).tolist()
        self._suffix = suffix
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        ends = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.searchsorted(keys // width, np.arange(len(start) + 1))
        #: Whether a suffix ends at the node, so that its first child is the leaf of the closing 0.
        self._ended = (keys[np.minimum(first[:-1], len(keys) - 1)] % width == 0).tolist()
        first, ends = first.tolist(), ends[order].tolist()
        # The children of each node in ascending order of symbols, the closing 0 first; none for leaves.
        self._children = [ends[a:b] for a, b in zip(first, first[1:])]

    def suffixes(self, descending: bool = False) -> np.ndarray:
        """The suffixes in ascending order; with ``descending``, by the turned order of symbols, in which an ended suffix is still the smaller one."""
        found, stack = [], [0]
        children, suffix, ended = self._children, self._suffix, self._ended
        while stack:
            at = stack.pop()
            below = children[at]
            if not below:
                found.append(suffix[at])
            elif not descending:
                stack += below[::-1]
            elif ended[at]:
                stack += below[1:]
                stack.append(below[0])
            else:
                stack += below
        return np.array(found[1:], dtype=np.int64)

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and where in it each suffix has its leaf."""
        span, suffix, children = self._span, self._suffix, self._children
        depths, places = [0], [0] * self._size
        stack = [(0, 0, iter(children[0]))]
        while stack:
            at, depth, rest = stack[-1]
            child = next(rest, -1)
            if child < 0:
                stack.pop()
                if stack:
                    depths.append(stack[-1][1])
                continue
            below = depth + span[child]
            if children[child]:
                depths.append(below)
                stack.append((child, below, iter(children[child])))
            else:
                places[suffix[child]] = len(depths)
                depths += (below, depth)
        return np.array(depths, dtype=np.int64), np.array(places, dtype=np.int64)


class Agreement:
    """How many symbols two suffixes share, for many pairs at once, by lowest common ancestors on the Euler tour of a suffix tree."""

    def __init__(self, tree: SuffixTree):
        depths, self._places = tree.tour()
        size = -(-len(depths) // _BLOCK) * _BLOCK
        self._depths = np.concatenate((depths, np.full(size - len(depths), np.iinfo(np.int64).max)))
        blocks = self._depths.reshape(-1, _BLOCK)
        self._before = np.minimum.accumulate(blocks, axis=1).ravel()
        self._after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._table = [blocks.min(axis=1)]
        while (2 << (len(self._table) - 1)) <= len(blocks):
            last, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self._places[a], self._places[b]), np.maximum(self._places[a], self._places[b])
        first, last = low // _BLOCK, high // _BLOCK
        found = np.minimum(self._after[low], self._before[high])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            begin, count = first[inner] + 1, last[inner] - first[inner] - 1
            level = np.frexp(count)[1] - 1
            least = found[inner]
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                table = self._table[k]
                least[at] = np.minimum(least[at], np.minimum(table[begin[at]], table[begin[at] + count[at] - (1 << k)]))
            found[inner] = least
        near = np.flatnonzero(first == last)
        if len(near):
            offsets = np.arange(_BLOCK)
            inside = (offsets >= low[near, None] % _BLOCK) & (offsets <= high[near, None] % _BLOCK)
            rows = self._depths.reshape(-1, _BLOCK)[first[near]]
            found[near] = np.where(inside, rows, np.iinfo(np.int64).max).min(axis=1)
        return found


def _next_smaller(order: np.ndarray) -> np.ndarray:
    """For each place, the next place whose suffix is smaller; the end if there is none. ``order`` holds the suffixes in ascending order."""
    size = len(order)
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.arange(size)
    found, ranks, stack = [size] * size, rank.tolist(), []
    for i, own in enumerate(ranks):
        while stack and ranks[stack[-1]] > own:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, dtype=np.int64)


def runs(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """All runs of a sequence, as rows (start, length, period) in ascending order of start and period."""
    size = len(symbols)
    numbers = np.unique(symbols, return_inverse=True)[1] + 1
    tree = SuffixTree(numbers.tolist())
    ends = [_next_smaller(tree.suffixes(turned)) for turned in (False, True)]
    forward = Agreement(tree)
    del tree
    backward = Agreement(SuffixTree(numbers[::-1].tolist()))
    i, j = np.concatenate((np.arange(size), np.arange(size))), np.concatenate(ends)
    closed = j < size
    i, j = i[closed], j[closed]
    right = forward.of(i, j)
    # The places before i and j, seen from the end; the closing symbol follows the first place, so nothing lies before it.
    left = backward.of(size - i, size - j)
    period, start, length = j - i, i - left, j - i + left + right
    enough = length >= np.maximum(least, exponent * period)
    return np.unique(np.stack((start, length, period), axis=1)[enough], axis=0)


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans of places that together hold every run whole. ``owner`` tells the text of each place, ascending; spans stay inside a text."""
    size = len(codes)
    if size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = codes.astype(np.uint64)
    triple = own[:-2] * _MIX[0] + own[1:-1] * _MIX[1] + own[2:] * _MIX[2] + owner[:-2].astype(np.uint64) * _MIX[3]
    triple ^= triple >> np.uint64(29)
    places = np.flatnonzero(owner[:-2] == owner[2:])
    order = places[np.argsort(triple[places], kind="stable")]
    distance = np.full(size, size + 1, dtype=np.int64)
    again = np.flatnonzero(triple[order[1:]] == triple[order[:-1]])
    distance[order[1:][again]] = order[1:][again] - order[again]
    first = np.searchsorted(owner, owner, side="left")
    after = np.searchsorted(owner, owner, side="right")
    longest = int((after - first).max())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    band = 1
    while True:
        periods = np.arange(band // 2 + 1, band + 1)
        needed = int(np.maximum(least - periods, (exponent - 1) * periods).min()) - 2
        if needed + band // 2 + 1 > longest:
            break
        if needed < 1:
            whole = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
            found.append((whole, after[whole]))
        else:
            close = np.concatenate(([False], distance <= band, [False]))
            edges = np.flatnonzero(close[1:] != close[:-1])
            a, b = edges[::2], edges[1::2]
            kept = b - a >= needed
            a, b = a[kept], b[kept]
            found.append((np.maximum(a - band, first[a]), np.minimum(b + 2, after[b - 1])))
        band *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (np.concatenate(x) for x in zip(*found))
    # A span at most touches that of the next text, and must not become one with it.
    start, end = merged_spans(start + owner[start], end + owner[start])
    shift = owner[np.searchsorted(np.arange(size) + owner, start)]
    return start - shift, end - shift


def _found(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], _SLICE):
                words = [text.split() for text in encoded(part.column("text"))]
                counts = np.array([len(w) for w in words], dtype=np.int64)
                flat = [w for own in words for w in own]
                codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                del flat
                before = np.concatenate(([0], np.cumsum(counts)))
                owner = np.repeat(np.arange(len(words)), counts)
                of_row: dict[int, list[np.ndarray]] = {}
                for a, b in zip(*(x.tolist() for x in stretches(codes, owner, least, exponent))):
                    row = int(owner[a])
                    here = runs(codes[a:b], least, exponent)
                    if len(here):
                        here[:, 0] += a - before[row]
                        of_row.setdefault(row, []).append(here)
                lists, texts = [], []
                for row, own in enumerate(words):
                    here = np.concatenate(of_row[row]) if row in of_row else ()
                    lists.append([{"start": s, "length": n, "period": q} for s, n, q in (x.tolist() for x in here)])
                    if len(here):
                        gone = np.zeros(len(own) + 1, dtype=np.int64)
                        np.add.at(gone, here[:, 0] + here[:, 2], 1)
                        np.add.at(gone, here[:, 0] + here[:, 1], -1)
                        own = [w for w, covered in zip(own, np.cumsum(gone).tolist()) if not covered]
                    texts.append(b" ".join(own))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                kept = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=[*(c for c in part.schema.names if c != "text"), "n_words", "runs", "collapsed"],
                )

    return run


def without_repetitions(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` (start word, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text of the words that no run repeats, joined by one space: of every run only the first period stays.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(_found(least, exponent), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
