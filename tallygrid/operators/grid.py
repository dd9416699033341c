"""Cells as a grid: order of rows and columns, what collapsed totals hide, and the wide table."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import parse_accounting, sort_key
from ..functions.labels import TOTAL_LABEL, join_key
from ..plans.spec import Axis, ViewSpec
from ..session import checkpointed, ship
from .changes import precedence
from .ordering import ordered_chunks, with_index


# Chunks whose effects are put together in one task.
COMPOSED = 1024


def _axes(spec: ViewSpec, rows: bool) -> tuple[Axis, ...]:
    return spec.row_axes if rows else spec.col_axes


def headers(cells: DataFrame, spec: ViewSpec, rows: bool = True, as_of: str | None = None, tenors: tuple[str, ...] = (),
            ranks: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """The distinct row (or column) labels with their sort keys ``_sort_0`` ... and the joined text ``_text``."""
    axes = _axes(spec, rows)
    columns = [F.col(f"`{a.column}`") for a in axes]
    labels = cells.select(*columns).distinct()
    keys = [
        sort_key(c, c == TOTAL_LABEL, a.attribute, as_of, tenors, ranks).alias(f"_sort_{i}")
        for i, (a, c) in enumerate(zip(axes, columns))
    ]
    return labels.select(*columns, *keys, join_key(columns).alias("_text"))


def _sorted(labels: DataFrame, axes: tuple[Axis, ...], chunk_rows: int | None = None) -> DataFrame:
    order = [f"_sort_{i}" for i in range(len(axes))]
    return ordered_chunks(labels, order, chunk_rows) if chunk_rows else ordered_chunks(labels, order)


def grid_order(cells: DataFrame, spec: ViewSpec, rows: bool = True, **sorting) -> DataFrame:
    """Each row (or column) of the grid with its position; totals come before what they total."""
    axes = _axes(spec, rows)
    chunks = _sorted(headers(cells, spec, rows, **sorting).withColumn("_all", F.lit(0)), axes)
    return with_index(chunks, ["_all"], "position").select(*[F.col(f"`{a.column}`") for a in axes], "position")


def _with_collapsed(labels: DataFrame, axes: tuple[Axis, ...], expanded: DataFrame | None) -> DataFrame:
    """Mark total rows (columns) that are closed, which they are unless listed in ``expanded``."""
    columns = [F.col(f"`{a.column}`") for a in axes]
    has_total = F.lit(False)
    for c in columns:
        has_total = has_total | (c == TOTAL_LABEL)
    if expanded is None:
        return labels.withColumn("_collapsed", has_total)
    names = [a.column for a in axes]
    opened = expanded.select(*names).distinct().withColumn("_open", F.lit(True))
    return labels.join(opened, names, "left").withColumn("_collapsed", has_total & F.col("_open").isNull()).drop("_open")


def _composed(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
    """What a run of chunks, one after the other, makes of every start state."""
    run = run.sort_values("_chunk")
    states = list(range(-1, len(run["_ends"].iloc[0]) - 1))
    for after in run["_ends"]:
        states = [int(after[s + 1]) for s in states]
    return pd.DataFrame({"_chunk": [key[0]], "_ends": [states]})


def _linked(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
    """The start state of every chunk of a run that starts in ``_start``."""
    run = run.sort_values("_chunk")
    starts, state = [], int(run["_start"].iloc[0])
    for after in run["_ends"]:
        starts.append(state)
        state = int(after[state + 1])
    return pd.DataFrame({"_chunk": run["_chunk"], "_start": starts})


def start_states(ends: DataFrame, block: int | None = None) -> DataFrame:
    """The state (from -1) in which each chunk starts, from ``_chunk`` and ``_ends``, the state after the chunk for every state before it.

    What chunks do to a state can be put together, so runs of ``block`` chunks are composed into one, these again, and so on, and the start
    states are handed back down: no task holds more than ``block`` chunks.
    """
    ship(ends.sparkSession)
    block = block or COMPOSED
    grouped = ends.withColumn("_block", F.floor(F.col("_chunk") / block).cast("bigint"))
    composed = checkpointed(grouped.groupBy("_block").applyInPandas(_composed, "_chunk bigint, _ends array<int>"))
    if composed.filter("_chunk <> 0").isEmpty():
        above = composed.select(F.col("_chunk").alias("_block"), F.lit(-1).alias("_start"))
    else:
        above = start_states(composed, block).withColumnRenamed("_chunk", "_block")
    return grouped.join(above, "_block").groupBy("_block").applyInPandas(_linked, "_chunk bigint, _start int")


def row_visibility(cells: DataFrame, spec: ViewSpec, expanded: DataFrame | None = None, chunk_rows: int | None = None,
                   chunk_block: int | None = None, **sorting) -> DataFrame:
    """Grid rows with ``hidden_row``: a closed total row hides what follows, up to and including the next open one.

    A row that ends a block is judged before it ends it. Only a ``Total`` past the first character of the joined row
    labels ends a block.
    """
    axes = spec.row_axes
    labels = _with_collapsed(headers(cells, spec, True, **sorting), axes, expanded)
    state = F.when(F.col("_collapsed"), F.lit(True)).when(F.instr("_text", TOTAL_LABEL) > 1, F.lit(False))
    chunks = _sorted(labels.withColumn("_state", state), axes, chunk_rows)
    earlier = Window.partitionBy("_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_at"))).cast("int") - 1
    # Outside (-1) and inside a closed block (0): a chunk without any ending passes on what it gets.
    ends = chunks.groupBy("_chunk").agg(F.array(F.coalesce(end, F.lit(-1)), F.coalesce(end, F.lit(0))).alias("_ends"))
    carried = start_states(ends, chunk_block)
    judged = chunks.withColumn("_inside", F.last("_state", ignorenulls=True).over(earlier)).join(carried, "_chunk")
    hidden = F.coalesce("_inside", F.col("_start") >= 0)
    return judged.select(*[F.col(f"`{a.column}`") for a in axes], hidden.alias("hidden_row"))


def _walk_columns(run: pd.DataFrame, state: int) -> tuple[list[bool], int]:
    """Hide flags of a run of columns, and the state after it. State: -1 outside a block, else the block's level."""
    flags = []
    for bits, own, closed in zip(run["_bits"], run["_last"], run["_collapsed"]):
        if state >= 0 and not (bits >> state) & 1:
            flags.append(True)
            continue
        flags.append(False)
        state = own if closed else -1
    return flags, state


def column_visibility(cells: DataFrame, spec: ViewSpec, expanded: DataFrame | None = None, chunk_rows: int | None = None,
                      chunk_block: int | None = None, **sorting) -> DataFrame:
    """Grid columns with ``hidden_col``: a closed total column hides what follows, until a column that has ``Total``
    at the last total level of the closed one.

    A closed column that is itself hidden opens no block, so each column depends on the one before. Chunks of the
    ordered columns are walked for every possible start state, these outcomes are composed (:func:`start_states`), and each chunk is walked
    once more from its own.
    """
    axes = spec.col_axes
    depth = len(axes)
    columns = [F.col(f"`{a.column}`") for a in axes]
    labels = _with_collapsed(headers(cells, spec, False, **sorting), axes, expanded)
    bits, last = F.lit(0), F.lit(-1)
    for i, c in enumerate(columns):
        bits = bits + F.when(c == TOTAL_LABEL, F.lit(1 << i)).otherwise(F.lit(0))
        last = F.when(c == TOTAL_LABEL, F.lit(i)).otherwise(last)
    marked = labels.withColumns({"_bits": bits, "_last": last})
    chunks = _sorted(marked, axes, chunk_rows)

    def outcomes(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("_at")
        ends = [_walk_columns(run, state)[1] for state in range(-1, depth)]
        return pd.DataFrame({"_chunk": [key[0]], "_ends": [ends]})

    narrow = chunks.select("_chunk", "_at", "_bits", "_last", "_collapsed")
    ends = narrow.groupBy("_chunk").applyInPandas(outcomes, "_chunk bigint, _ends array<int>")
    starts = start_states(ends, chunk_block)

    names = [a.column for a in axes]
    schema = ", ".join([*[f"`{n}` string" for n in names], "hidden_col boolean"])

    def judged(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("_at")
        flags, _ = _walk_columns(run, int(run["_start"].iloc[0]))
        return run[names].assign(hidden_col=flags)

    return chunks.join(starts, "_chunk").groupBy("_chunk").applyInPandas(judged, schema)


def visible_grid(cells: DataFrame, spec: ViewSpec, expanded_rows: DataFrame | None = None,
                 expanded_cols: DataFrame | None = None, **sorting) -> DataFrame:
    """The cells that a grid with closed totals shows. ``cells`` is read three times; pass a checkpointed table."""
    rows = row_visibility(cells, spec, expanded_rows, **sorting).filter(~F.col("hidden_row")).drop("hidden_row")
    cols = column_visibility(cells, spec, expanded_cols, **sorting).filter(~F.col("hidden_col")).drop("hidden_col")
    return cells.join(rows, [a.column for a in spec.row_axes], "left_semi").join(
        cols, [a.column for a in spec.col_axes], "left_semi"
    )


def column_names(cells: DataFrame, spec: ViewSpec, separator: str = "\t") -> list[str]:
    """The distinct column labels, joined. More than ``spark.sql.pivotMaxValues`` of them is an error, as in a pivot."""
    bound = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    text = F.concat_ws(separator, *[F.col(f"`{a.column}`") for a in spec.col_axes])
    found = [r[0] for r in cells.select(text.alias("name")).distinct().limit(bound + 1).collect()]
    if len(found) > bound:
        raise ValueError(f"view {spec.name} has more than {bound} columns; narrow it or keep it in long form")
    return sorted(found)


def _shown_value(cells: DataFrame):
    """The widest total wins over what reads the same."""
    return F.max_by("value", precedence(cells))


def wide(cells: DataFrame, spec: ViewSpec, columns: list[str] | None = None, separator: str = "\t") -> DataFrame:
    """Row labels down, column labels across.

    Without ``columns`` the cells are read twice, first for their column names, so they are kept in a checkpoint.
    """
    if columns is None:
        cells = checkpointed(cells)
    names = column_names(cells, spec, separator) if columns is None else columns
    text = F.concat_ws(separator, *[F.col(f"`{a.column}`") for a in spec.col_axes])
    rows = [F.col(f"`{a.column}`") for a in spec.row_axes]
    return cells.withColumn("_across", text).groupBy(*rows).pivot("_across", names).agg(_shown_value(cells))


def pages(cells: DataFrame, spec: ViewSpec, width: int = 100, **sorting) -> tuple[DataFrame, DataFrame]:
    """A grid of any number of columns, cut into pages of ``width``: its headers and its pages.

    Headers: ``page``, ``place``, and the column labels, in grid order. Pages: ``page``, the row labels, and a number per place, ``c0`` and on.
    The order of the columns is worked out by tasks and the places have fixed names, so no column name passes through the driver.
    """
    cells = checkpointed(cells)
    names = [a.column for a in spec.col_axes]
    order = checkpointed(grid_order(cells, spec, rows=False, **sorting).select(
        F.floor(F.col("position") / width).cast("bigint").alias("page"), (F.col("position") % width).cast("int").alias("place"), *[F.col(f"`{n}`") for n in names]
    ))
    placed = cells.join(order, names)
    rows = [F.col(f"`{a.column}`") for a in spec.row_axes]
    shown = placed.groupBy("page", *rows).pivot("place", list(range(width))).agg(_shown_value(cells))
    return order, shown.select("page", *rows, *[F.col(f"`{i}`").alias(f"c{i}") for i in range(width)])


def without_empty(grid: DataFrame, row_columns: list[str]) -> DataFrame:
    """Drop rows and columns of a wide table that hold no number."""
    grid = checkpointed(grid)
    data = [c for c in grid.columns if c not in row_columns]
    filled = grid.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(data)]).first()
    kept = [c for i, c in enumerate(data) if filled[i] > 0]
    some = F.lit(False)
    for c in kept:
        some = some | F.col(f"`{c}`").isNotNull()
    return grid.filter(some).select(*[F.col(f"`{c}`") for c in (*row_columns, *kept)])


def selection_total(shown: DataFrame, selection: DataFrame, keys: list[str], text: str = "shown") -> DataFrame:
    """Sum of the displayed numbers of the selected cells."""
    picked = shown.join(selection.select(*keys).distinct(), keys, "left_semi")
    return picked.agg(F.sum(parse_accounting(F.col(text))).alias("total"))
