"""Differences between elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Layout
from .elements import flatten

BASELINE_SUFFIX = "-SOD"


def subtract_positional(left: DataFrame, right: DataFrame, layout: Layout, on: list[str] | None = None) -> DataFrame:
    """``left - right`` point by point for elements of equal size; labels come from the left.

    Elements of another size, or without a partner, keep their numbers.
    """
    keys = on or [layout.key]
    other = right.select(*[F.col(f"`{k}`") for k in keys], F.col(layout.points).alias("_other"))
    joined = left.join(other, keys, "left")

    def minus(p: Column, o: Column) -> Column:
        labels = [p[n].alias(n) for n in layout.perimeter]
        return F.struct(*labels, (p[layout.value] - o[layout.value]).alias(layout.value))

    points = F.when(
        F.size(layout.points) == F.size("_other"), F.zip_with(layout.points, "_other", minus)
    ).otherwise(F.col(layout.points))
    return joined.withColumn(layout.points, points).drop("_other")


def subtract_by_labels(left: DataFrame, right: DataFrame, layout: Layout) -> DataFrame:
    """``left - right`` matched on key and all labels, for elements of any shape.

    Pairs give the difference, left-only rows stay, right-only rows are negated. The two sides are stacked and
    summed, which needs one shuffle, reduces rows before it, and treats null labels as equal.
    """
    keys = [layout.key, *layout.attributes]
    columns = [F.col(f"`{k}`") for k in keys]
    plus = flatten(left, layout).select(*columns, F.col(layout.value))
    minus = flatten(right, layout).select(*columns, (-F.col(layout.value)).alias(layout.value))
    return plus.unionByName(minus).groupBy(*columns).agg(F.sum(layout.value).alias(layout.value))


def against_baseline(newest: DataFrame, layout: Layout, suffix: str = BASELINE_SUFFIX, factor: float = 1.0,
                     measure: str = "double") -> DataFrame:
    """Every element minus ``factor`` times its baseline, the element stored under the key plus ``suffix``.

    Elements without a baseline stay as they are, and so do the baselines themselves. ``newest`` holds the newest
    version per key and is read three times; pass a stored or checkpointed table. Points are matched on all labels.
    """
    width = len(suffix)
    key = F.col(f"`{layout.key}`")
    rows = flatten(newest, layout)
    labels = [F.col(f"`{n}`") for n in layout.attributes]
    value = F.col(layout.value).cast(measure)
    own = rows.select(key, *labels, value.alias(layout.value))
    scaled = -value if factor == 1.0 else -value * F.lit(factor).cast(measure)
    baselines = rows.filter(key.endswith(suffix)).select(
        F.substring(key, F.lit(1), F.length(key) - width).alias(layout.key),
        *labels,
        scaled.cast(own.schema[layout.value].dataType).alias(layout.value),
    )
    matched = baselines.join(newest.select(key), layout.key, "left_semi")
    return own.unionByName(matched).groupBy(key, *labels).agg(F.sum(layout.value).alias(layout.value))
