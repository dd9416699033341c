"""Small helpers that the operators share: tables, buckets, packed arrays, shared folders."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text per bucket of packed shuffle rows. The number of buckets grows with the input.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
SLICE_BYTES = 8 << 20


_kept: list[dict] = []


def kept(name: dict) -> dict:
    """A table that a Python worker keeps from task to task, until another operator calls :func:`let_go`."""
    _kept.append(name)
    return name


def let_go() -> None:
    """Empty all tables kept by earlier operators: Spark hands its Python workers on from stage to stage, with all they hold.

    What the worker has freed goes back to the machine, as the allocators would hold on to it.
    """
    for one in _kept:
        one.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: Only glibc has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text under fixed names; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(size: int) -> int:
    """Buckets for a shuffle of what ``size`` bytes of text give rise to."""
    return max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of record batches with about ``size`` bytes of text each, which bounds what a task holds beside its input."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encoded(column: pa.Array) -> list[bytes]:
    """Strings of an Arrow column as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(kinds: tuple, *columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed blob, each byte plane apart, so that high bytes cost little.

    ``kinds`` are numpy types, or a number k for the k low bytes of 64-bit numbers.
    """
    out = [np.uint32(len(columns[0])).tobytes()]
    for kind, column in zip(kinds, columns):
        own = np.ascontiguousarray(column, dtype="<u8" if isinstance(kind, int) else kind)
        planes = own.view(np.uint8).reshape(len(own), -1).T
        out.append(np.ascontiguousarray(planes[:kind] if isinstance(kind, int) else planes).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def unpack(kinds: tuple, blob: bytes) -> list[np.ndarray]:
    """What :func:`pack` packed."""
    raw = pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="lz4", asbytes=True)
    n, at, found = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        whole = np.dtype("<u8" if isinstance(kind, int) else kind)
        width = kind if isinstance(kind, int) else whole.itemsize
        planes = np.zeros((n, whole.itemsize), dtype=np.uint8)
        planes[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        found.append(planes.reshape(-1).view(whole))
        at += n * width
    return found


def unpacked(kinds: tuple, blobs: list[bytes]) -> list[np.ndarray]:
    """The packed columns of many blobs, joined."""
    if not blobs:
        return unpack(kinds, pack(kinds, *(np.zeros(0, "u8") for _ in kinds)))
    return [np.concatenate(x) for x in zip(*(unpack(kinds, b) for b in blobs))]


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return [(int(v), rows) for v, rows in zip(values, np.split(order, first[1:]))]


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans as maximal runs in ascending order; spans that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[new], reach[np.concatenate((new[1:], [len(start)])) - 1]
