"""Tab-separated element files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Layout

# Fixed values of the format: the header of the number column, and the comment mark.
VALUE_HEADER = "#VALUE#"
COMMENT = "#"

FILE_SEQ = ("seq_file", "seq_block", "seq_line")


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; a file of the folder with another header fails the reading query."""
    first = spark.read.text(path).limit(1).collect()
    return _checked(first[0][0].strip().split("\t") if first else [], path)


def _checked(names: list[str], path: str) -> list[str]:
    if VALUE_HEADER not in names:
        raise ValueError(f"{path}: no column {VALUE_HEADER}")
    return names


def _elements(lines: DataFrame, names: list[str], float32: bool, mode: str, empty_as_null: bool,
              seq: tuple[str, ...]) -> tuple[DataFrame, Layout]:
    if mode not in ("fail", "drop"):
        raise ValueError(f"unknown mode {mode}")
    line = _stripped(F.col("value"))
    # A line with the header of the number column is a header, whatever it starts with; it must be the expected one.
    header = "\t".join(names)
    is_header = F.when(line.contains(VALUE_HEADER), F.array_contains(F.split(line, "\t"), VALUE_HEADER)).otherwise(F.lit(False))
    other = F.raise_error(F.concat(F.lit("unexpected header: "), line)).cast("boolean")
    is_data = F.when(is_header, F.when(line == header, F.lit(False)).otherwise(other)).otherwise(~line.startswith(COMMENT))
    lines = lines.filter((line != "") & is_data)
    fields = lines.select(F.split(line, "\t").alias("_fields"), *seq)

    def field(name: str) -> Column:
        return F.get("_fields", F.lit(names.index(name)))

    def number(cast) -> Column:
        text = F.trim(field(VALUE_HEADER))
        return cast(cast(text, "float"), "double") if float32 else cast(text, "double")

    def label(name: str) -> Column:
        return F.nullif(field(name), F.lit("")) if empty_as_null else field(name)

    value = number(Column.try_cast)
    if mode == "fail":
        missing = F.raise_error(F.concat(F.lit("no number in line: "), F.array_join("_fields", "\t")))
        value = F.coalesce(number(Column.cast), missing.cast("double"))
    labels = [n for n in names if n != VALUE_HEADER]
    rows = fields.select(
        field(labels[0]).alias("invariant_key"), *[label(n).alias(n) for n in labels], value.alias("value"), *seq
    )
    if mode == "drop":
        rows = rows.filter(F.col("value").isNotNull())
    return rows, Layout(core=tuple(labels), seq=seq)


def read_tsv(spark: SparkSession, path: str, float32: bool = True, mode: str = "fail",
             empty_as_null: bool = False) -> tuple[DataFrame, Layout]:
    """Elements of tab-separated files: all labels core, the first label column is the key, a later line is newer.

    Numbers go through 32 bits unless ``float32`` is off. A number that is missing or does not parse fails the query, or with
    ``mode='drop'`` loses its line. A file whose header has other columns, or the same in another order, fails the query. Labels missing at the end of a line read as null, empty ones as empty text or, with
    ``empty_as_null``, as null too. Large files are split among tasks.
    """
    names = header_of(spark, path)
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("seq_file"),
        F.col("_metadata.file_block_start").alias("seq_block"),
        F.monotonically_increasing_id().alias("seq_line"),
    )
    return _elements(lines, names, float32, mode, empty_as_null, FILE_SEQ)


def stream_tsv(spark: SparkSession, path: str, names: list[str], seq: str, float32: bool = True, mode: str = "fail",
               empty_as_null: bool = False, max_files: int | None = None) -> tuple[DataFrame, Layout]:
    """The streaming form. Files arrive in no fixed order, so a label column must carry the order as ``seq``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows, layout = _elements(reader.text(path), _checked(names, path), float32, mode, empty_as_null, ())
    labels = tuple(n for n in layout.core if n != seq)
    return rows.withColumn("seq", F.col(f"`{seq}`").cast("bigint")), Layout(core=labels, seq=("seq",))


def write_tsv(df: DataFrame, path: str, labels: list[str], value: str) -> None:
    """Write elements in the format :func:`read_tsv` reads; the first label is the key. Null and empty labels are both written empty."""
    columns = [F.col(f"`{n}`").cast("string").alias(n) for n in labels]
    (
        df.select(*columns, F.col(f"`{value}`").cast("string").alias(VALUE_HEADER))
        .write.option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).csv(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """A grid or detail rows as comma-separated files with a header."""
    df.write.option("header", True).csv(path)
