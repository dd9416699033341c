"""Label expressions: reading, testing, renaming, joining and splitting labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Layout

# What a missing label reads as, what a total shows, and the key separators.
NULL_LABEL = "-"
TOTAL_LABEL = "Total"
LABEL_SEPARATOR = "\t"
AXIS_SEPARATOR = "\f"


def raw(name: str) -> Column:
    """The stored label, null kept."""
    return F.col(f"`{name}`").cast("string")


def value_label(layout: Layout, name: str) -> Column:
    """The label as views see it: null reads as ``-``, and an unknown attribute reads as its own name."""
    if name in layout.attributes:
        return F.coalesce(raw(name), F.lit(NULL_LABEL))
    return F.lit(name)


def core_label(layout: Layout, name: str) -> Column:
    """The label as stored on the element: null when it is null, unknown or a perimeter attribute."""
    if name in layout.core:
        return raw(name)
    return F.lit(None).cast("string")


def one_of(layout: Layout, name: str, accepted: Sequence[str]) -> Column:
    """Does the label equal one of ``accepted``?

    Written on the plain column wherever possible so that the test reaches the file scan; the null-reading form
    is needed only when ``-`` itself is accepted.
    """
    accepted = list(dict.fromkeys(accepted))
    if name not in layout.attributes:
        return F.lit(name in accepted)
    column = raw(name)
    test = column.isin(accepted)
    if NULL_LABEL in accepted:
        test = test | column.isNull()
    return test


def renamed(layout: Layout, name: str, mapping: Mapping[str, str] | None) -> Column:
    """The label after renaming; values without an entry pass through."""
    label = value_label(layout, name)
    if not mapping:
        return label
    table = F.create_map(*[F.lit(part) for entry in mapping.items() for part in entry])
    return F.coalesce(table[label], label)


def with_renamed(df: DataFrame, layout: Layout, name: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Add the label after renaming as ``out``, through a lookup table of known size; meant for sums, not for raw rows.

    No hint is given: the planner broadcasts the table below its threshold and else joins both sides by the label.
    """
    label = value_label(layout, name)
    table = df.sparkSession.createDataFrame(pa.table({
        "_from": pa.array(list(mapping), pa.string()), "_to": pa.array(list(mapping.values()), pa.string()),
    }))
    named = df.withColumn("_label", label).join(table, F.col("_label") == F.col("_from"), "left")
    return named.withColumn(out, F.coalesce("_to", "_label")).drop("_label", "_from", "_to")


def join_key(columns: Sequence[Column]) -> Column:
    """Labels of one axis as one text."""
    return F.concat_ws(LABEL_SEPARATOR, *columns)


def split_key(column: Column) -> Column:
    """The labels of a joined text; trailing empty labels are not kept."""
    return F.split(F.regexp_replace(column, f"{LABEL_SEPARATOR}+$", ""), LABEL_SEPARATOR)


def cell_key(cols: Sequence[Column], rows: Sequence[Column]) -> Column:
    """Column labels, then row labels, as one text."""
    return F.concat(join_key(cols), F.lit(AXIS_SEPARATOR), join_key(rows))
