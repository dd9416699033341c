"""Element to element operators: flatten, copy, negate, resize, de-duplicate, catalogue."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import value_label
from ..model import Layout


def flatten(df: DataFrame, layout: Layout, only: Collection[str] | None = None) -> DataFrame:
    """One row per point, core labels repeated, perimeter labels appended; an element without points gives none.

    ``only`` names the perimeter labels the caller reads. The others are not read from the files either: fields of an
    exploded array are pruned only when the array is put together from the fields in use.
    """
    if not layout.is_nested(df):
        return df
    kept = [F.col(f"`{c}`") for c in df.columns if c != layout.points]
    names = [n for n in layout.perimeter if only is None or n in only] + [layout.value]
    points = F.col(layout.points)
    if len(names) < len(layout.perimeter) + 1:
        points = F.arrays_zip(*[points[n] for n in names])
    # The outer form followed by a filter: the plain form makes the optimizer test the size of the array in an extra
    # filter, which computes a derived array a second time.
    exploded = df.select(*kept, F.posexplode_outer(points).alias(layout.pos, "_point"))
    return exploded.filter(F.col(layout.pos).isNotNull()).select(
        *kept, layout.pos, *[F.col("_point")[n].alias(n) for n in names]
    )


def point(layout: Layout, labels: Mapping[str, Column | str | None], value: Column) -> Column:
    """One entry of the ``points`` array."""
    fields = []
    for name in layout.perimeter:
        label = labels.get(name)
        column = label if isinstance(label, Column) else F.lit(label)
        fields.append(column.cast("string").alias(name))
    return F.struct(*fields, value.cast("double").alias(layout.value))


def empty_point(layout: Layout) -> Column:
    """A point without labels whose number is 0, used for padding."""
    return point(layout, {}, F.lit(0.0))


def _point_with(layout: Layout, p: Column, value: Column) -> Column:
    return F.struct(*[p[name].alias(name) for name in layout.perimeter], value.alias(layout.value))


def negated(df: DataFrame, layout: Layout) -> DataFrame:
    """The same labels with every number sign-flipped."""
    if layout.is_nested(df):
        return df.withColumn(
            layout.points, F.transform(layout.points, lambda p: _point_with(layout, p, -p[layout.value]))
        )
    return df.withColumn(layout.value, -F.col(layout.value))


def copied(df: DataFrame, layout: Layout, key: Column | None = None,
           core: Mapping[str, Column] | None = None, seq: Mapping[str, Column] | None = None) -> DataFrame:
    """A copy, optionally under a new key, with new core labels, and with a renewed ``seq``."""
    changes: dict[str, Column] = {}
    if key is not None:
        changes[layout.key] = key
    for name, column in (core or {}).items():
        if name not in layout.core:
            raise ValueError(f"{name} is not a core attribute")
        changes[name] = column
    changes.update(seq or {})
    return df.withColumns(changes) if changes else df


def resized(df: DataFrame, layout: Layout, size: int) -> DataFrame:
    """Exactly ``size`` points: the first ones, padded with empty points when there are fewer."""
    points = F.col(layout.points)
    missing = F.greatest(F.lit(size) - F.size(points), F.lit(0))
    return df.withColumn(
        layout.points, F.concat(F.slice(points, 1, size), F.array_repeat(empty_point(layout), missing))
    )


def filtered_copy(df: DataFrame, layout: Layout, attribute: str, old: str, new: str, key: Column) -> DataFrame:
    """The value rows whose label equals ``old``, with that label set to ``new``, under another key.

    No row matches, no row results; there is no empty element.
    """
    rows = flatten(df, layout)
    kept = rows.filter(value_label(layout, attribute) == old)
    changes = {layout.key: key}
    if attribute in layout.attributes:
        changes[attribute] = F.lit(new)
    return kept.withColumns(changes)


def deduplicated(df: DataFrame, layout: Layout) -> DataFrame:
    """Of the points of one element with equal perimeter labels, keep the last; the order is kept.

    Works inside each row, so it runs on streams and never shuffles. The points are sorted by labels, each is
    compared with its successor only, and the survivors are put back in order.
    """
    labels = layout.perimeter
    keyed = F.transform(
        layout.points, lambda p, i: F.struct(F.struct(*[p[n].alias(n) for n in labels]).alias("labels"), i.alias("at"))
    )
    staged = df.withColumn("_sorted", F.sort_array(keyed))
    following = F.slice("_sorted", F.lit(2), F.greatest(F.size(layout.points), F.lit(1)))
    staged = staged.withColumn("_next", following).withColumn("_pairs", F.arrays_zip("_sorted", "_next"))
    last = F.filter("_pairs", lambda p: p["_next"].isNull() | ~p["_sorted"]["labels"].eqNullSafe(p["_next"]["labels"]))
    kept = F.sort_array(F.transform(last, lambda p: p["_sorted"]["at"]))
    back = F.transform(kept, lambda at: F.get(layout.points, at))
    return staged.withColumn(layout.points, back).drop("_sorted", "_next", "_pairs")


def deduplicated_rows(df: DataFrame, layout: Layout, order: list[str]) -> DataFrame:
    """The flat form of :func:`deduplicated`: the last row by ``order`` per key and perimeter labels.

    An aggregation, so that a key or a label tuple with very many rows is reduced before the shuffle.
    """
    keys = [layout.key, *layout.perimeter]
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order]))
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(last.alias("_last"))
    return grouped.select(*[F.col(f"`{k}`") for k in keys], "_last.*").select(*[F.col(f"`{c}`") for c in df.columns])


def index_of(layout: Layout, points: Column, target: Column, attributes: list[str]) -> Column:
    """Position of the first point whose labels equal those of ``target`` (a point), -1 when there is none."""

    def tuple_of(p: Column) -> Column:
        return F.struct(*[F.coalesce(p[n], F.lit("-")).alias(n) for n in attributes])

    found = F.array_position(F.transform(points, tuple_of), tuple_of(target))
    return (F.coalesce(found, F.lit(0)) - F.lit(1)).cast("int")


def attribute_catalog(df: DataFrame, layout: Layout, counted: bool = True) -> DataFrame:
    """One row per attribute: name, position, whether it is core, and how many elements carry a value for it.

    Without ``counted`` the names come from the layout alone and no data is read; ``labelled`` is null then.
    """
    if counted:
        source = flatten(df, layout).agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in layout.attributes])
    else:
        source = df.sparkSession.range(1).select(*[F.lit(None).cast("bigint").alias(n) for n in layout.attributes])
    entries = F.array(*[
        F.struct(
            F.lit(n).alias("name"),
            F.lit(i).alias("position"),
            F.lit(layout.is_core(n)).alias("is_core"),
            F.col(f"`{n}`").alias("labelled"),
        )
        for i, n in enumerate(layout.attributes)
    ])
    return source.select(F.inline(entries))


def nested_schema(layout: Layout) -> T.ArrayType:
    """Type of the ``points`` column."""
    fields = [T.StructField(n, T.StringType()) for n in layout.perimeter]
    return T.ArrayType(T.StructType([*fields, T.StructField(layout.value, T.DoubleType())]))
