"""From value rows to view cells: filter, label, sum, total."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import TOTAL_LABEL, one_of, renamed, value_label, with_renamed
from ..model import Layout
from ..plans.spec import Axis, ViewSpec, total_sets
from .elements import flatten

# Low bits summed apart from the rest in exact sums of whole units.
HALF_BITS = 20


def view_filter(layout: Layout, spec: ViewSpec) -> Column:
    """All filters of a view: every filtered attribute must have one of its listed values."""
    tests = [one_of(layout, name, accepted) for name, accepted in spec.filters.items()]
    return reduce(and_, tests) if tests else F.lit(True)


def axis_label(layout: Layout, spec: ViewSpec, axis: Axis, rename: bool = True) -> Column:
    """The label of one axis level, renamed unless told otherwise; a level without attribute reads as empty text."""
    if axis.attribute == "":
        return F.lit("")
    return renamed(layout, axis.attribute, spec.renames.get(axis.attribute) if rename else None)


def _renames_of(spec: ViewSpec) -> list[tuple[Axis, dict[str, str]]]:
    return [(a, dict(spec.renames[a.attribute])) for a in spec.axes if spec.renames.get(a.attribute)]


def fixed_scale(measure: str) -> int | None:
    """The number of decimals of a ``fixed(n)`` measure, None for any other."""
    match = re.fullmatch(r"fixed\((\d+)\)", measure)
    return int(match.group(1)) if match else None


def measured(layout: Layout, measure: str) -> Column:
    """The number to sum, in the form :func:`summed` takes.

    ``double`` sums the input as it is. ``fixed(2)`` is for numbers of at most two decimals and sums whole hundredths,
    which is exact, the same in any order, and cheaper than decimals. ``decimal(p,s)`` casts to that type.
    """
    column = F.col(layout.value)
    if measure == "double":
        return column
    scale = fixed_scale(measure)
    return column.cast(measure) if scale is None else F.rint(column * F.lit(float(10**scale))).cast("bigint")


def summed(measure: str) -> Column:
    """The sum of the column ``value`` made by :func:`measured`.

    Whole units are summed as two 64-bit halves, so the sum of any number of rows stays exact without decimals per row.
    """
    scale = fixed_scale(measure)
    if scale is None:
        return F.sum("value").alias("value")
    high, low = F.shiftright("value", HALF_BITS), F.col("value").bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    whole = F.sum(high).cast("decimal(19,0)") * F.lit(1 << HALF_BITS).cast("decimal(8,0)")
    units = whole + F.sum(low).cast("decimal(19,0)")
    return (units * F.lit(Decimal(1).scaleb(-scale))).alias("value")


def labelled(df: DataFrame, layout: Layout, spec: ViewSpec, measure: str = "double",
             keep: Sequence[str] = (), rename: bool = True) -> DataFrame:
    """The value rows a view takes, reduced to its labels and the number; ``keep`` passes further columns on."""
    rows = df
    if layout.is_nested(df):
        rows = flatten(df.filter(_core_filter(layout, spec)), layout, attributes_read([spec]))
    return rows.filter(view_filter(layout, spec)).select(
        *[F.col(f"`{k}`") for k in keep],
        *[axis_label(layout, spec, a, rename).alias(a.column) for a in spec.axes],
        measured(layout, measure).alias("value"),
    )


def view_sums(df: DataFrame, layout: Layout, spec: ViewSpec, measure: str = "double") -> DataFrame:
    """One row per cell of a view. Rows are summed by their stored labels; only these sums are renamed and summed again.

    So a rename of any length costs a lookup per sum, and no raw row is shuffled by the label to rename.
    """
    sums = cell_sums(labelled(df, layout, spec, measure, rename=False), spec, measure)
    renames = _renames_of(spec)
    if not renames:
        return sums
    for axis, mapping in renames:
        known = Layout(core=(axis.column,))
        sums = with_renamed(sums, known, axis.column, mapping, "_renamed").drop(axis.column)
        sums = sums.withColumnRenamed("_renamed", axis.column)
    return sums.groupBy(*[F.col(f"`{c}`") for c in spec.columns]).agg(F.sum("value").alias("value"))


def attributes_read(specs: Sequence[ViewSpec]) -> set[str]:
    """The attributes that any of the views shows or filters."""
    return {a.attribute for s in specs for a in s.axes} | {n for s in specs for n in s.filters}


def _core_filter(layout: Layout, spec: ViewSpec) -> Column:
    tests = [one_of(layout, n, v) for n, v in spec.filters.items() if n in layout.core]
    return reduce(and_, tests) if tests else F.lit(True)


def cell_sums(rows: DataFrame, spec: ViewSpec, measure: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell. Each task sums its own rows first, so only cells are shuffled."""
    keys = [F.col(f"`{c}`") for c in (*keep, *spec.columns)]
    return rows.groupBy(*keys).agg(summed(measure))


def with_totals(cells: DataFrame, spec: ViewSpec, rule: str = "documented", keep: Sequence[str] = (), levels: bool = False) -> DataFrame:
    """Cells plus total cells, with ``is_total`` and ``hidden``.

    Totals are summed from the cells, which are few, and not from the value rows. ``is_total`` comes from the
    grouping, so a stored label that reads ``Total`` is not mistaken for one. With ``levels`` there is a column ``level``, the number of labels
    that a total stands for, by which the wider of two totals that read the same is told.
    """
    sets = total_sets(spec, rule)
    hidden = F.lit(spec.is_hidden)
    keys = [*keep, *spec.columns]
    if not sets:
        return cells.select(
            *[F.col(f"`{c}`") for c in keys], "value", F.lit(False).alias("is_total"), hidden.alias("hidden"), *([F.lit(0).alias("level")] if levels else [])
        )
    every = [list(range(len(spec.axes)))] + [list(s) for s in sets]
    grouping_sets = [[*[F.col(f"`{k}`") for k in keep], *[F.col(f"`{spec.columns[i]}`") for i in s]] for s in every]
    flags = [F.grouping(c).alias(f"_total_{i}") for i, c in enumerate(spec.columns)]
    grouped = cells.groupingSets(grouping_sets, *[F.col(f"`{c}`") for c in keys]).agg(
        F.sum("value").alias("value"), *flags
    )
    is_total = reduce(or_, [F.col(f"_total_{i}") == 1 for i in range(len(spec.axes))])
    return grouped.select(
        *[F.col(f"`{k}`") for k in keep],
        *[
            F.when(F.col(f"_total_{i}") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col(f"`{c}`")).alias(c)
            for i, c in enumerate(spec.columns)
        ],
        "value",
        is_total.alias("is_total"),
        (hidden & ~is_total).alias("hidden"),
        *([reduce(add, [F.col(f"_total_{i}") for i in range(len(spec.axes))]).cast("int").alias("level")] if levels else []),
    )


def visible(cells: DataFrame) -> DataFrame:
    """Cells that are published: a view with a hidden label publishes its totals only."""
    return cells.filter(~F.col("hidden"))


def _variants(spec: ViewSpec, rule: str) -> list[tuple[int, ...]]:
    width = range(len(spec.axes))
    return [tuple(width), *total_sets(spec, rule)]


def fan_out(df: DataFrame, layout: Layout, specs: Sequence[ViewSpec], measure: str = "double") -> DataFrame:
    """Every value row under every view that takes it: ``view, col_keys, row_keys, value``.

    All views are served by one pass over the input. Rows no view takes are filtered out first, and rows that agree
    in every attribute any of the views reads are summed first, so the fan-out copies sums and not rows.
    """
    core = reduce(or_, [_core_filter(layout, s) for s in specs])
    read = attributes_read(specs)
    rows = flatten(df.filter(core), layout, read) if layout.is_nested(df) else df
    rows = rows.filter(reduce(or_, [view_filter(layout, s) for s in specs]))
    shared = [F.col(f"`{n}`") for n in layout.attributes if n in read]
    rows = rows.select(*shared, measured(layout, measure).alias("value")).groupBy(*shared).agg(summed(measure))
    places: dict[tuple, str] = {}
    for axis, mapping in (r for s in specs for r in _renames_of(s)):
        key = (axis.attribute, *mapping.items())
        if key not in places:
            places[key] = f"_renamed_{len(places)}"
            rows = with_renamed(rows, layout, axis.attribute, mapping, places[key])

    def label(spec: ViewSpec, axis: Axis) -> Column:
        mapping = spec.renames.get(axis.attribute)
        return F.col(places[axis.attribute, *mapping.items()]) if mapping else axis_label(layout, spec, axis)

    entries = []
    for spec in specs:
        entry = F.struct(
            F.lit(spec.name).alias("view"),
            F.array(*[label(spec, a) for a in spec.axes if a.is_column]).alias("col_keys"),
            F.array(*[label(spec, a) for a in spec.axes if not a.is_column]).alias("row_keys"),
        )
        entries.append(F.when(view_filter(layout, spec), entry))
    return (
        rows.select("value", F.explode(F.array(*entries)).alias("_cell"))
        .filter(F.col("_cell").isNotNull())
        .select("_cell.*", "value")
    )


def many_views(df: DataFrame, layout: Layout, specs: Sequence[ViewSpec], measure: str = "double",
               rule: str = "documented") -> DataFrame:
    """The cells of many views in one table: ``view, col_keys, row_keys, value, is_total, hidden``."""
    base = (
        fan_out(df, layout, specs, measure).groupBy("view", "col_keys", "row_keys").agg(F.sum("value").alias("value"))
    )
    if not any(total_sets(s, rule) for s in specs):
        totalled = base.withColumn("is_total", F.lit(False))
    else:
        choice = None
        for spec in specs:
            width_cols = len(spec.col_axes)
            levels = []
            for number, kept in enumerate(_variants(spec, rule)):
                cols = [i for i in range(width_cols) if i not in kept]
                rows = [i - width_cols for i in range(width_cols, len(spec.axes)) if i not in kept]
                levels.append(F.struct(
                    F.lit(number).alias("number"),
                    F.array(*[F.lit(i) for i in cols]).cast("array<int>").alias("cols"),
                    F.array(*[F.lit(i) for i in rows]).cast("array<int>").alias("rows"),
                ))
            test = F.col("view") == spec.name
            choice = F.when(test, F.array(*levels)) if choice is None else choice.when(test, F.array(*levels))

        def masked(labels: str, mask: str) -> Column:
            return F.transform(
                labels, lambda x, i: F.when(F.array_contains(mask, i), F.lit(TOTAL_LABEL)).otherwise(x)
            )

        totalled = (
            base.select("view", "col_keys", "row_keys", "value", F.explode(choice).alias("_level"))
            .select("view", F.col("_level.number").alias("_number"), F.col("_level.cols").alias("_cols"),
                    F.col("_level.rows").alias("_rows"), "col_keys", "row_keys", "value")
            .select("view", "_number", masked("col_keys", "_cols").alias("col_keys"),
                    masked("row_keys", "_rows").alias("row_keys"), "value")
            .groupBy("view", "_number", "col_keys", "row_keys")
            .agg(F.sum("value").alias("value"))
            .withColumn("is_total", F.col("_number") > 0)
            .drop("_number")
        )
    concealed = [s.name for s in specs if s.is_hidden]
    hidden = F.col("view").isin(concealed) if concealed else F.lit(False)
    return totalled.withColumn("hidden", hidden & ~F.col("is_total"))
