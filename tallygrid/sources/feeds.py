"""Element feeds from files, in batch and as streams, and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _as_glob(path: str) -> str:
    """A pattern that matches exactly ``path``: a stream may then name a single file as well as a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{name[:-1]}[{name[-1]}]"


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                 max_files: int | None = None, **options) -> DataFrame:
    """New files of a folder, or one file, as a stream. ``max_files`` bounds a micro-batch (back-pressure)."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(_as_glob(path))


def write_snapshot(cells: DataFrame, path: str, only_visible: bool = True) -> None:
    """All published cells of a view, changed or not, replacing the previous snapshot."""
    shown = cells.filter("NOT hidden") if only_visible and "hidden" in cells.columns else cells
    shown.write.mode("overwrite").parquet(path)


def write_records(json_records: DataFrame, path: str) -> None:
    """Append JSON records, one per line."""
    json_records.write.mode("append").text(path)
