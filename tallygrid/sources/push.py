"""A push source: producers hand over elements as they have them, and a stream takes them up, each exactly once.

A producer writes what is pushed to its own lane, a folder of numbered segments in storage that all can reach. A segment is written under another
name and then renamed, so it is there whole or not at all. The offset of the stream is the number of segments taken per lane; it lies in the
checkpoint of the query, so a restart goes on after the last micro-batch and repeats one that was not committed with the very same segments.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import by_value, ship

by_value(__name__)

FORMAT = "pushed_elements"
_SEGMENT = ".arrow"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return store, path.rstrip("/")


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _segments(store: fs.FileSystem, lane: str) -> int:
    """How many segments a lane has without a gap."""
    found = {f.base_name for f in store.get_file_info(fs.FileSelector(lane, allow_not_found=True)) if f.base_name.endswith(_SEGMENT)}
    count = len(found)
    return count if f"{count - 1}{_SEGMENT}" in found or not count else next(i for i in range(count + 1) if f"{i}{_SEGMENT}" not in found)


class Producer:
    """The sending side. A lane has one producer at a time; ``lane`` continues one, or names that of a task that may be run again.

    ``stamp`` names a whole-number column to fill with a number that rises with every row pushed, for elements whose order is that of their arrival.
    ``first`` numbers the next segment; a task that is run again starts at 0 and writes the same segments over.
    """

    def __init__(self, folder: str, schema: T.StructType | str, lane: str | None = None, stamp: str | None = None, first: int | None = None):
        self._store, path = _opened(folder)
        self._lane = f"{path}/{lane or uuid.uuid4().hex}"
        self._schema, self._stamp = to_arrow_schema(_schema(schema)), stamp
        self._store.create_dir(self._lane, recursive=True)
        self._next = _segments(self._store, self._lane) if first is None else first
        self._last = 0

    def push(self, elements: Iterable[dict] | pa.RecordBatch | pa.Table) -> int:
        """Hand over elements and return the number of their segment. When this returns, they are safe."""
        if isinstance(elements, pa.RecordBatch):
            elements = pa.Table.from_batches([elements])
        rows = elements if isinstance(elements, pa.Table) else list(elements)
        if self._stamp is not None:
            count = len(rows)
            first = max(time.time_ns(), self._last + 1)
            self._last = first + count
            if isinstance(rows, pa.Table):
                rows = rows.append_column(self._stamp, pa.array(range(first, first + count), pa.int64()))
            else:
                rows = [{**row, self._stamp: first + i} for i, row in enumerate(rows)]
        table = rows.select(self._schema.names).cast(self._schema) if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows, self._schema)
        hidden, target = f"{self._lane}/.{uuid.uuid4().hex}", f"{self._lane}/{self._next}{_SEGMENT}"
        with self._store.open_output_stream(hidden) as out, pa.ipc.new_file(out, self._schema) as writer:
            writer.write_table(table)
        self._store.move(hidden, target)
        self._next += 1
        return self._next - 1


class _Part(InputPartition):
    """Some segments of a lane."""

    def __init__(self, lane: str, first: int, after: int):
        super().__init__(f"{lane}:{first}:{after}")
        self.lane, self.first, self.after = lane, first, after


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self._folder, self._schema = options["path"], schema
        self._most = int(options.get("segmentsPerPartition", "64"))

    def initialOffset(self) -> dict:
        return {"lanes": "{}"}

    def latestOffset(self) -> dict:
        store, path = _opened(self._folder)
        lanes = [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory]
        counts = {lane: _segments(store, f"{path}/{lane}") for lane in sorted(lanes)}
        return {"lanes": json.dumps({lane: n for lane, n in counts.items() if n}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["lanes"]), json.loads(end["lanes"])
        return [
            _Part(lane, a, min(a + self._most, n)) for lane, n in after.items() for a in range(before.get(lane, 0), n, self._most)
        ] or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, path = _opened(self._folder)
        wanted = to_arrow_schema(self._schema)
        for number in range(partition.first, partition.after):
            with store.open_input_file(f"{path}/{partition.lane}/{number}{_SEGMENT}") as source:
                yield from pa.ipc.open_file(source).read_all().select(wanted.names).cast(wanted).to_batches()

    def commit(self, end: dict) -> None:
        """Segments are kept; their owner removes what no checkpoint needs any more."""


class PushedElements(DataSource):
    """The receiving side, as a Spark data source."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema of the elements")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


def pushed(spark: SparkSession, folder: str, schema: T.StructType | str, **options) -> DataFrame:
    """What producers push to a folder, as a stream. Elements are told apart and ordered by their own key and order columns."""
    ship(spark).dataSource.register(PushedElements)
    return spark.readStream.format(FORMAT).schema(_schema(schema)).options(**options).load(folder)
