"""View definitions as values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class Axis:
    """One label level of a view: output column, attribute it reads, and whether it runs across or down."""

    column: str
    attribute: str
    is_column: bool


@dataclass(frozen=True)
class ViewSpec:
    """What a view shows.

    ``rows`` and ``cols`` are attributes in display order, ``filters`` maps an attribute to its accepted values,
    ``renames`` maps an attribute to old -> new labels, ``totals`` and ``hide`` name attributes. ``transform`` names
    a registered function that changes the elements first, with ``transform_arg`` as its argument.
    """

    name: str
    rows: tuple[str, ...] = ()
    cols: tuple[str, ...] = ()
    totals: tuple[str, ...] = ()
    hide: tuple[str, ...] = ()
    filters: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    renames: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    description: str | None = None
    transform: str | None = None
    transform_arg: str | None = None

    @property
    def shown_description(self) -> str:
        return self.name if self.description is None else self.description

    def _side(self, names: tuple[str, ...], is_column: bool, empty: str, taken: set[str]) -> tuple[Axis, ...]:
        axes = []
        for attribute in names or ("",):
            column = attribute or empty
            while column in taken:
                column += "_"
            taken.add(column)
            axes.append(Axis(column, attribute, is_column))
        return tuple(axes)

    @property
    def axes(self) -> tuple[Axis, ...]:
        """Column levels, then row levels. A side without attributes has one level with an empty label."""
        taken: set[str] = set()
        cols = self._side(self.cols, True, "col_label", taken)
        return cols + self._side(self.rows, False, "row_label", taken)

    @property
    def col_axes(self) -> tuple[Axis, ...]:
        return tuple(a for a in self.axes if a.is_column)

    @property
    def row_axes(self) -> tuple[Axis, ...]:
        return tuple(a for a in self.axes if not a.is_column)

    @property
    def columns(self) -> list[str]:
        return [a.column for a in self.axes]

    @property
    def is_hidden(self) -> bool:
        """True when any label attribute is hidden; then only totals are published."""
        return bool(set(self.hide) & {a.attribute for a in self.axes})


def total_sets(spec: ViewSpec, rule: str) -> list[tuple[int, ...]]:
    """Positions in ``spec.axes`` that keep their label, one tuple per kind of total cell.

    ``documented``: replace at most one totalled row label and at most one totalled column label, not none of both.
    ``observed``: keep at most one label per side, counted from the first one, and replace all others. It is defined
    for views with one row label.
    """
    if rule == "none" or not spec.totals:
        return []
    width_cols = len(spec.col_axes)
    size = len(spec.axes)
    col_at = [i for i in range(width_cols) if spec.axes[i].attribute in spec.totals]
    row_at = [i for i in range(width_cols, size) if spec.axes[i].attribute in spec.totals]
    if rule == "documented":
        found = [
            tuple(i for i in range(size) if i not in (row, col))
            for row, col in product([None, *row_at], [None, *col_at])
            if (row, col) != (None, None)
        ]
    elif rule == "observed":
        if not col_at and not row_at:
            return []
        if len(spec.rows) != 1:
            raise ValueError(f"view {spec.name}: the observed rule is defined for exactly one row label")
        found = [
            tuple(i for i in (col, row) if i is not None)
            for row, col in product([None, *range(width_cols, width_cols + len(row_at))], [None, *range(len(col_at))])
            if (row, col) != (None, None)
        ]
        found = [kept for kept in found if len(kept) < size]
    else:
        raise ValueError(f"unknown rule for totals: {rule}")
    return list(dict.fromkeys(found))
