"""What changed between two states of the same cells, and the records that tell a consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import accounting
from ..plans.spec import ViewSpec

# The smallest change of a total that is reported, and the record names.
TOTAL_CHANGE = 1e-8
UPDATE, DELETE, DELETE_ROW, DELETE_COLUMN, HEADER = "UPD", "DEL", "DELR", "DELC", "DIM"


def precedence(cells: DataFrame) -> Column:
    """Which of several cells with the same labels counts: the total of most labels, else any total, else the larger number."""
    total = F.col("is_total").cast("int") if "is_total" in cells.columns else F.lit(0)
    level = F.col("level") if "level" in cells.columns else total
    return F.struct(total.alias("total"), level.alias("level"), F.col("value").alias("value"))


def _side(cells: DataFrame, keys: list[str], before: bool) -> DataFrame:
    total = F.col("is_total") if "is_total" in cells.columns else F.lit(False)
    hidden = F.col("hidden") if "hidden" in cells.columns else F.lit(False)
    return cells.filter(~hidden).select(
        *[F.col(f"`{k}`") for k in keys], F.struct("value", total.alias("is_total")).alias("_cell"), precedence(cells).alias("_rank"), F.lit(before).alias("_was")
    )


def cell_changes(previous: DataFrame, current: DataFrame, keys: list[str],
                 touched: DataFrame | None = None) -> DataFrame:
    """``keys, is_total, command, before, value`` for every visible cell that changed or vanished.

    Base cells are reported when new, different, or listed in ``touched``; total cells when they moved by more than
    1e-8, a new total counting from 0. Cells marked ``hidden`` are neither reported nor deleted, as no consumer has them;
    a cell that becomes hidden is deleted. Where several cells have the same labels, the widest total counts. Both
    states are stacked and reduced per cell in a single shuffle.
    """
    sides = _side(previous, keys, True).unionByName(_side(current, keys, False))
    columns = [F.col(f"`{k}`") for k in keys]
    merged = sides.groupBy(*columns).agg(
        F.max_by("_cell", F.when(F.col("_was"), F.col("_rank"))).alias("_before"),
        F.max_by("_cell", F.when(~F.col("_was"), F.col("_rank"))).alias("_after"),
    ).select(
        *columns,
        F.coalesce("_after.is_total", "_before.is_total").alias("is_total"),
        F.col("_before.value").alias("before"),
        F.col("_after.value").alias("value"),
        F.col("_before").isNotNull().cast("int").alias("was"),
        F.col("_after").isNotNull().cast("int").alias("is"),
    )
    moved = F.abs(F.col("value") - F.coalesce("before", F.lit(0).cast("double"))) > TOTAL_CHANGE
    different = (F.col("was") == 0) | (F.col("value") != F.col("before"))
    if touched is not None:
        marks = touched.select(*columns).distinct().withColumn("_touched", F.lit(True))
        merged = merged.join(marks, keys, "left")
        different = different | F.coalesce("_touched", F.lit(False))
    command = F.when(F.col("is") == 0, F.lit(DELETE)).when(
        F.when(F.col("is_total"), moved).otherwise(different), F.lit(UPDATE)
    )
    return merged.select(*columns, "is_total", command.alias("command"), "before", "value").filter(
        F.col("command").isNotNull()
    )


def vanished(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the earlier state that the later one does not have."""
    columns = [F.col(f"`{k}`") for k in keys]
    return previous.select(*columns).distinct().join(current.select(*columns).distinct(), keys, "left_anti")


def published(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The visible cells, one per set of labels: a total replaces whatever it totals whose labels read the same."""
    shown = cells.filter(~F.col("hidden")) if "hidden" in cells.columns else cells
    if "is_total" not in cells.columns:
        return shown
    columns = [F.col(f"`{k}`") for k in keys]
    rest = [F.col(f"`{c}`") for c in cells.columns if c not in keys]
    one = shown.groupBy(*columns).agg(F.max_by(F.struct(*rest), precedence(shown)).alias("_one"))
    return one.select(*columns, "_one.*")


def update_records(cells: DataFrame, spec: ViewSpec) -> DataFrame:
    """One record per visible cell: ``viewName, command, rowKeys, colKeys, value`` with the number as shown.

    Where a total and a base cell read the same, the total's record is the one that counts.
    """
    shown = published(cells, spec.columns)
    command = F.col("command") if "command" in cells.columns else F.lit(UPDATE)
    return shown.select(
        F.lit(spec.name).alias("viewName"),
        command.alias("command"),
        F.array(*[F.col(f"`{a.column}`") for a in spec.row_axes]).alias("rowKeys"),
        F.array(*[F.col(f"`{a.column}`") for a in spec.col_axes]).alias("colKeys"),
        F.when(command == UPDATE, accounting(F.col("value"))).alias("value"),
    )


def vanished_axis_records(previous: DataFrame, current: DataFrame, spec: ViewSpec, rows: bool = True) -> DataFrame:
    """One record per row (or column) of which no cell is left."""
    axes = spec.row_axes if rows else spec.col_axes
    gone = vanished(previous, current, [a.column for a in axes])
    labels = F.array(*[F.col(f"`{a.column}`") for a in axes])
    return gone.select(
        F.lit(spec.name).alias("viewName"),
        F.lit(DELETE_ROW if rows else DELETE_COLUMN).alias("command"),
        labels.alias("rowKeys" if rows else "colKeys"),
    )


def header_records(headers: DataFrame) -> DataFrame:
    """One record per view with its label names and description, from ``view, row_labels, col_labels, description``."""
    return headers.select(
        F.col("view").alias("viewName"),
        F.lit(HEADER).alias("command"),
        F.col("row_labels").alias("rowKeys"),
        F.col("col_labels").alias("colKeys"),
        "description",
    )


def as_json(records: DataFrame) -> DataFrame:
    """Records as JSON text in a ``value`` column, ready for a text or message sink."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))
