"""Views over batch input, and the registry of element transforms."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Layout
from ..operators import cells as c
from ..operators.difference import against_baseline
from .spec import ViewSpec

Transform = Callable[..., DataFrame]
_transforms: dict[str, Transform] = {}


def register_transform(name: str, function: Transform) -> None:
    """Make ``function(df, layout[, argument])`` available to views under ``name``."""
    _transforms[name] = function


def _against_baseline(df: DataFrame, layout: Layout, factor: str = "1.0") -> DataFrame:
    return against_baseline(df, layout, factor=float(factor))


# The transform that takes another element into account; streams keep it in state.
BASELINE_TRANSFORM = "against baseline"

register_transform(BASELINE_TRANSFORM, _against_baseline)


def baseline_factor(spec: ViewSpec) -> float:
    """How many times the baseline is taken from an element."""
    return 1.0 if spec.transform_arg is None else float(spec.transform_arg)


def transformed(df: DataFrame, layout: Layout, spec: ViewSpec) -> DataFrame:
    """Apply the transform of a view, with its argument if the function takes one."""
    if spec.transform is None:
        return df
    if spec.transform not in _transforms:
        raise ValueError(f"view {spec.name}: no transform named {spec.transform}")
    function = _transforms[spec.transform]
    takes_argument = len(inspect.signature(function).parameters) > 2
    if takes_argument and spec.transform_arg is not None:
        return df.transform(function, layout, spec.transform_arg)
    return df.transform(function, layout)


def view_cells(df: DataFrame, layout: Layout, spec: ViewSpec, measure: str = "double", rule: str = "documented",
               only_visible: bool = False, levels: bool = False) -> DataFrame:
    """All cells of a view over elements of which each key occurs in one version.

    Columns: the column labels, the row labels, ``value``, ``is_total``, ``hidden``, and with ``levels`` how many labels a total stands
    for. What goes on as records or as a grid needs it if labels may read ``Total``.
    """
    result = c.with_totals(c.view_sums(transformed(df, layout, spec), layout, spec, measure), spec, rule, levels=levels)
    if only_visible:
        result = c.visible(result)
    if measure != "double":
        result = result.withColumn("value", F.col("value").cast("double"))
    return result


def all_views(df: DataFrame, layout: Layout, specs: Sequence[ViewSpec], measure: str = "double",
              rule: str = "documented") -> DataFrame:
    """Many views at once. Views that share their input share one pass over it; transforms get their own."""
    plain = [s for s in specs if s.transform is None]
    parts = [c.many_views(df, layout, plain, measure, rule)] if plain else []
    for spec in specs:
        if spec.transform is not None:
            parts.append(c.many_views(transformed(df, layout, spec), layout, [spec], measure, rule))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if measure != "double":
        result = result.withColumn("value", F.col("value").cast("double"))
    return result
