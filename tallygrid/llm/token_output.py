"""Token output: documents as token ids in blocks that are coded with a static range asymmetric numeral system.

Documents are sorted by id over shards, encoded once and written as plain packed ids. Counts over all ids give one table of
frequencies, stored beside the blocks. Each shard is then cut into blocks of whole documents, and each block is coded on its
own with interleaved lanes and checkpoints (see ``rans``). The files are a Parquet data set, so that any store that
Spark writes to will do and a lost task leaves nothing half-written; the payload is opaque bytes. A block's row holds its shard,
first id, documents, checkpoints and a checksum of its ids, which decoding verifies.

A null text has no ids but its end id, as an empty one. A null id sorts first and is kept. Rows that repeat an id are
documents of their own, in any order among themselves. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir
from . import rans
from .common import documents, slices, text_bytes
from .tokens import byte_bpe

_BLOCK_TOKENS = 1 << 18
_MOST_LANES = 1024
_STEPS_PER_CHECKPOINT = 128
_SHARD_BYTES = 32 << 20
_DOCUMENT = "shard int, first long, doc_id long, ids binary"
_BLOCK = (
    "shard int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, lanes int, "
    "checkpoint_words array<long>, checkpoint_states binary, words binary, ids_crc32 long"
)


class TokenFiles(NamedTuple):
    """Where the blocks and the table of frequencies lie."""

    blocks: str
    table: str


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        end = np.array([end_id], dtype=tokenizer.kind).tobytes()
        total = 0  # a task is a shard
        for batch in batches:
            ids = [tokenizer.ids(text or "") + end for text in batch.column("text").to_pylist()]
            after = total + np.cumsum([len(x) // tokenizer.kind.itemsize for x in ids], dtype=np.int64)
            first = np.concatenate(([total], after))[: len(ids)]
            total = int(after[-1]) if len(ids) else total
            columns = [batch.column("shard"), pa.array(first, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "first", "doc_id", "ids"])

    return run


def _counts(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in slices(batches, column="ids"):
            # One count over many documents: the vocabulary is larger than most of them.
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["token", "n"])

    return run


def _block_row(shard: int, first: int, docs: list, parts: list[bytes], kind: str, table: rans.Table) -> tuple:
    ids = np.frombuffer(b"".join(parts), dtype=kind).astype(np.uint32)
    lanes = min(_MOST_LANES, max(1, len(ids) // _STEPS_PER_CHECKPOINT))
    words, at, states = rans.encode(ids, table, lanes, _STEPS_PER_CHECKPOINT)
    width = np.dtype(kind).itemsize
    return (
        shard, first, len(ids), docs, [len(p) // width for p in parts], lanes, at.tolist(), states.astype("<u8").tobytes(),
        words.astype("<u4").tobytes(), zlib.crc32(ids.astype("<u4").tobytes()),
    )


_BLOCK_TYPES = (
    pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()),
    pa.binary(), pa.binary(), pa.int64(),
)


def _blocks(kind: str, frequency: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(np.frombuffer(frequency, dtype=np.uint64))
        shard, first, held = None, 0, 0
        docs: list = []
        parts: list[bytes] = []

        def row():
            values = _block_row(shard, first, docs, parts, kind, table)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for own, at, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (own != shard or at != first + held or held >= _BLOCK_TOKENS):
                    yield row()
                    parts = []
                if not parts:
                    shard, first, held, docs = own, at, 0, []
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // np.dtype(kind).itemsize
        if parts:
            yield row()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all documents in ascending id order and write them below ``path``, which all executors share."""
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    shards = max(1, -(-text_bytes(own) // _SHARD_BYTES))
    shards = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_docs = own.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").withColumn("shard", F.spark_partition_id())
    plain = f"{path}/ids"
    tokenizer = byte_bpe(tokenizer_path)
    sorted_docs.select("shard", "doc_id", "text").mapInArrow(_tokenized(tokenizer_path, end_id), _DOCUMENT).write.option("compression", "zstd").parquet(plain)
    encoded = spark.read.schema(_DOCUMENT).parquet(plain)
    kind = tokenizer.kind.str
    counts = encoded.select("ids").mapInArrow(_counts(kind, tokenizer.size), "token int, n long")
    found = counts.groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary has, at most
    count = np.zeros(tokenizer.size, dtype=np.int64)
    count[found.column("token").to_numpy()] = found.column("n").to_numpy()
    frequency = rans.frequencies(count)
    files = TokenFiles(f"{path}/blocks", f"{path}/table")
    spark.createDataFrame([(frequency.astype("<u8").tobytes(),)], "frequency binary").coalesce(1).write.parquet(files.table)
    # A task reads files, or parts of files, in the order they were written, so runs of documents need no second shuffle.
    encoded.mapInArrow(_blocks(kind, frequency.tobytes()), _BLOCK).write.option("compression", "none").parquet(files.blocks)
    return files


def _decoded(frequency: bytes, start: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(np.frombuffer(frequency, dtype="<u8"))
        for batch in batches:
            for row in batch.to_pylist():
                states = np.frombuffer(row["checkpoint_states"], dtype="<u8").reshape(-1, row["lanes"])
                words = np.frombuffer(row["words"], dtype="<u4")
                ids = rans.decode(words, np.array(row["checkpoint_words"]), states, row["n_tokens"], table, _STEPS_PER_CHECKPOINT)
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"the block at id {row['first_token']} of shard {row['shard']} does not match its checksum")
                lengths = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(lengths)
                first = start[row["shard"]] + row["first_token"] + ends - lengths
                parts = [raw[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (32-bit, little-endian)."""
    blocks = spark.read.parquet(files.blocks)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one row per shard of 32 MB or more
    start, total = {}, 0
    for row in sorted(totals):
        start[row["shard"]] = total
        total += row["n"]
    frequency = spark.read.parquet(files.table).first()[0]
    return blocks.mapInArrow(_decoded(bytes(frequency), start), "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write and read back; per document ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of its ids as read."""
    spark = docs.sparkSession
    files = write_tokens(docs, tokenizer_path, end_id, new_work_dir(spark, "tokens"))
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
