"""Exact search for the vectors of highest inner product, by an impact-ordered index that is read score at a time.

Vectors are dealt into blocks. In a block, the components of each dimension are quantised into levels; the vectors of a level form a posting
segment with a least and a greatest value. For a query, a segment's impact is the most it can add to a score beyond what every
vector gets in that dimension anyway, rounded up to a whole number of the query's units. A batch of queries reads a block together, in
descending order of the greatest impact that a segment has for any of them. What has been read gives each vector an upper bound. After each part
the reading stops if few vectors can still reach the k-th best score known of each query (or all segments are read), and these possible
members are scored exactly with integers.

A task holds a part of the queries and reads one block of vectors after the other, so the k best so far are known to the next block. Queries
and blocks meet by one shuffle, without a join: vectors travel once per share of the queries and queries once per part of the blocks, both in
integers of two or four bytes, and a task returns its best k per query only; the best of all tasks are exact.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. A query's own id is no candidate,
so rows that repeat it are none either; other repeated rows each count. Ties go to the smaller id. A vector whose components could take a
score beyond 64 bits is an error. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LEVELS = 32
_STEPS = 4
#: Rows whose accumulators, one per query of a batch, stay near the processor.
_RUN = 2048
#: Components of a block of vectors and of a batch of queries.
_BLOCK = 1 << 19
_BATCH = 1 << 14
#: Components of the queries that a task holds.
_HELD = 1 << 23
#: Pairs of a query and a vector that a task is worth while for, and up to how many tasks. Every task moves queries or vectors once more.
_TASKS = ((1 << 22, 32), (1 << 28, 256), (1 << 33, 1 << 20))


def whole_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(1024 x) of the rows that take part, and which these are."""
    known = np.isfinite(values).all(axis=1)
    values = values[known]
    # A score adds as many products as there are components, each within the square of the largest one.
    if len(values) and np.abs(values).max() > (2.0**62 / values.shape[1]) ** 0.5 / 1024.0 - 1.0:
        raise ValueError("components too large for scores of 64 bits")
    return np.floor(1024.0 * values).astype(np.int64), known


def whole_numbers(vector: list | None) -> np.ndarray | None:
    """floor(1024 x) of every component, or None if the vector takes no part."""
    if not vector or any(x is None for x in vector):
        return None
    rows, _ = whole_rows(np.array([vector], dtype=np.float64))
    return rows[0] if len(rows) else None


Best = tuple[np.ndarray, np.ndarray]


class ImpactIndex:
    """The posting segments of a block of vectors, all of one length; the postings of a segment lie by runs of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        level = (vectors - self.low) * _LEVELS // np.maximum(1, self.high - self.low + 1)
        segment = (level + np.arange(dims) * _LEVELS).T.astype(np.uint16 if dims * _LEVELS <= 1 << 16 else np.int64)
        there = np.flatnonzero(np.bincount(segment.ravel(), minlength=dims * _LEVELS))
        self.dimension = there // _LEVELS
        self.opening = np.searchsorted(self.dimension, np.arange(dims))
        self.least, self.greatest = np.full(len(there), np.iinfo(np.int64).max), np.full(len(there), np.iinfo(np.int64).min)
        self.runs = []
        for start in range(0, n, _RUN):
            keys = segment[:, start : start + _RUN].ravel()
            order = np.argsort(keys, kind="stable")
            first = np.searchsorted(keys[order], np.append(there, dims * _LEVELS))
            values, held = vectors[start : start + _RUN].T.ravel()[order], np.flatnonzero(np.diff(first))
            self.least[held] = np.minimum(self.least[held], np.minimum.reduceat(values, first[held]))
            self.greatest[held] = np.maximum(self.greatest[held], np.maximum.reduceat(values, first[held]))
            self.runs.append((slice(start, start + _RUN), first, order % min(_RUN, n - start)))

    def search(self, query: np.ndarray, own: int, k: int) -> Best:
        """Ids and scores of the k best vectors, best first, without those of id ``own``."""
        none = np.zeros(0, dtype=np.int64)
        return self.improved(query[None], np.array([own]), k, [(none, none)])[0]

    def improved(self, queries: np.ndarray, owners: np.ndarray, k: int, best: list[Best]) -> list[Best]:
        """The k best of ``best`` and of this block for each query, without vectors of its owner's id."""
        n, dims = self.vectors.shape
        kind, exact, most = (np.int16, np.float32, 32767) if dims < 8192 else (np.int32, np.float64, 2**31 - 1)
        ends = queries * self.low, queries * self.high
        floor = np.minimum(*ends)
        weight = queries.T[self.dimension]
        impact = np.maximum(weight * self.least[:, None], weight * self.greatest[:, None]) - floor.T[self.dimension]
        # In units in which no vector's impacts add up to more than the accumulators hold.
        unit = np.maximum(1, -(-(np.maximum(*ends) - floor).sum(axis=1) // (most - dims)))
        impact = (-(-impact // unit)).astype(kind)
        floor = floor.sum(axis=1)

        def needed(q: int, score: int) -> int:
            return min(max(-((int(floor[q]) - score) // int(unit[q])), 0), most)

        need = np.array([needed(q, int(s[-1])) if len(s) == k else 0 for q, (_, s) in enumerate(best)], dtype=kind)
        lacking = [q for q, (_, s) in enumerate(best) if len(s) < k]
        parts, unread = [], np.ones(len(impact), dtype=bool)
        for part in np.array_split(np.argsort(-impact.max(axis=1).astype(np.int64), kind="stable"), min(_STEPS, len(impact))):
            unread[part] = False
            # An open dimension of a vector adds no more than the greatest impact still unread there.
            frontier = None if lacking or not unread.any() else np.maximum.reduceat(np.where(unread[:, None], impact, 0), self.opening, axis=0).astype(exact)
            parts.append((np.sort(part), frontier))
        total, possible = np.zeros((n, len(queries)), dtype=kind), np.empty((n, len(queries)), dtype=bool)
        for rows, first, postings in self.runs:
            sums = total[rows]
            open_dims = np.ones((len(sums), dims), dtype=exact)
            for part, frontier in parts:
                self._read(part, first, postings, impact, sums, open_dims)
                if frontier is not None:
                    possible[rows] = sums + open_dims @ frontier >= need
                    if np.count_nonzero(possible[rows]) <= max(8 * k, len(sums) // 32) * len(queries):
                        break
            else:
                possible[rows] = sums >= need
        for q in lacking:
            top = np.argpartition(total[:, q], n - min(n, 2 * k))[n - min(n, 2 * k) :]
            scores = np.append(best[q][1], self.vectors[top[self.ids[top] != owners[q]]] @ queries[q])
            if len(scores) >= k:
                possible[:, q] = total[:, q] >= needed(q, int(np.partition(scores, -k)[-k]))
        rows, columns = np.nonzero(possible)
        order = np.argsort(columns, kind="stable")
        bounds = np.searchsorted(columns[order], np.arange(len(queries) + 1))
        return [self._merged(queries[q], owners[q], k, best[q], rows[order[a:b]]) if b > a else best[q] for q, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def _read(self, part: np.ndarray, first: np.ndarray, postings: np.ndarray, impact: np.ndarray, total: np.ndarray, open_dims: np.ndarray) -> None:
        """Add the impacts of some segments, in ascending order, to the vectors they hold in a run of rows."""
        length = first[part + 1] - first[part]
        segments = np.repeat(part, length)
        at = postings[np.arange(len(segments)) + np.repeat(first[part] - np.cumsum(length) + length, length)]
        dimension = self.dimension[segments]
        open_dims[at, dimension] = 0
        ends = [0, *(np.flatnonzero(np.diff(dimension)) + 1).tolist(), len(at)]
        for a, b in zip(ends, ends[1:]):  # a vector is in one segment of a dimension
            sums = total.take(at[a:b], axis=0)
            sums += impact.take(segments[a:b], axis=0)
            total[at[a:b]] = sums

    def _merged(self, query: np.ndarray, own: int, k: int, best: Best, rows: np.ndarray) -> Best:
        rows = rows[self.ids[rows] != own]
        ids, scores = np.append(best[0], self.ids[rows]), np.append(best[1], self.vectors[rows] @ query)
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _narrow(values: np.ndarray) -> bytes:
    """As little-endian integers of two bytes, or of four, which hold all that takes part."""
    return values.astype("<i2" if np.abs(values).max() < 1 << 15 else "<i4").tobytes()


def _wide(blob: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<i{len(blob) // (rows * dims)}").reshape(rows, dims).astype(np.int64)


def _packed(key, group):
    block, dims = (x.as_py() for x in key)
    values = pc.list_flatten(group.column("vector")).cast(pa.float64()).to_numpy()
    rows, known = whole_rows(values.reshape(-1, dims)) if dims else (values, values)
    blocks, ids, vectors = ([block], [group.column("vec_id").to_numpy()[known].astype("<i8").tobytes()], [_narrow(rows)]) if len(rows) else ([], [], [])
    return pa.table({"block": pa.array(blocks, pa.int32()), "dims": pa.array([dims] * len(blocks), pa.int32()), "ids": pa.array(ids, pa.binary()), "vectors": pa.array(vectors, pa.binary())})


def _searched(k: int):
    def found(asked: list) -> Iterator[pa.RecordBatch]:
        for owners, _, best in asked:
            columns = np.repeat(owners, [len(ids) for ids, _ in best]), np.concatenate([ids for ids, _ in best]), np.concatenate([scores for _, scores in best])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        asked, held = [], None
        for batch in batches:
            for cell, dims, is_block, ids, vectors in zip(*(batch.column(c) for c in ("cell", "dims", "is_block", "ids", "vectors"))):
                if held != (cell.as_py(), dims.as_py()):
                    yield from found(asked)
                    asked, held = [], (cell.as_py(), dims.as_py())
                ids = np.frombuffer(ids.as_py(), dtype="<i8")
                values = _wide(vectors.as_py(), len(ids), dims.as_py())
                if not is_block.as_py():
                    asked.append((ids, values, [(none, none)] * len(ids)))
                elif asked:
                    index = ImpactIndex(ids, values)
                    asked = [(owners, queries, index.improved(queries, owners, k, best)) for owners, queries, best in asked]
        yield from found(asked)

    return run


def _grid(vectors: tuple[int, int], queries: tuple[int, int]) -> tuple[int, int]:
    """Into how many parts blocks are dealt and into how many shares queries, from the rows and components of both."""
    pairs = vectors[0] * queries[0]
    tasks = max(1, *(min(pairs // least, most) for least, most in _TASKS))
    # Vectors travel once per share and queries once per part: this share moves least.
    shares = max(1, round(math.sqrt(tasks * queries[1] / max(1, vectors[1]))), -(-queries[1] // _HELD))
    return max(1, min(-(-tasks // shares), -(-vectors[1] // _BLOCK))), shares


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best vectors of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""

    def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, tuple[int, int]]:
        own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).filter("vec_id is not null and vector is not null")
        own = own.withColumn("dims", F.size("vector"))
        count, cells = own.select(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
        dealt = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-cells // size)))).cast("int"))
        return dealt.groupBy("block", "dims").applyInArrow(_packed, "block int, dims int, ids binary, vectors binary"), (count, cells)

    index, index_size = blocks(vectors, _BLOCK)
    asked, asked_size = blocks(queries, _BATCH)
    parts, shares = _grid(index_size, asked_size)

    def copies(rows: DataFrame, is_block: bool, dealt: int, other: int, step: int, other_step: int) -> DataFrame:
        """A row for each cell of the grid that needs it: its own place along one side, all along the other."""
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return rows.withColumn("other", everywhere).select((F.col("block") % dealt * step + F.col("other") * other_step).alias("cell"), "dims", F.lit(is_block).alias("is_block"), "ids", "vectors")

    # Not by a join: Spark would choose its kind, a broadcast through the driver too, by the size of the queries before their copies.
    met = copies(index, True, parts, shares, shares, 1).unionByName(copies(asked, False, shares, parts, 1, shares))
    met = met.repartitionById(parts * shares, "cell").sortWithinPartitions("cell", "dims", "is_block")
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
