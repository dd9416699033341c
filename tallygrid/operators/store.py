"""The newest version of every key, lookups, and the change log of replaced versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Layout
from .elements import flatten
from .ordering import with_neighbour


def _seq_value(layout: Layout) -> Column:
    """The order as one value that is never null, so that a version without ``seq`` counts, as the earliest one."""
    return F.struct(*[F.col(f"`{c}`") for c in layout.seq])


def latest(df: DataFrame, layout: Layout, per: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the version with the highest ``seq``. ``df`` holds one row per version.

    An aggregation, so each task first reduces its rows to one per key; a key with very many versions costs no
    more shuffle than any other. ``per`` adds grouping columns, such as an epoch.
    """
    keys = [*per, layout.key]
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), _seq_value(layout))
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(newest.alias("_newest"))
    return grouped.select(*[F.col(f"`{k}`") for k in keys], "_newest.*").select(*[F.col(f"`{c}`") for c in df.columns])


def latest_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """All value rows of the newest version of each key, for flat input with several rows per version.

    Rows meet the newest ``seq`` on (key, seq), not on the key alone, so the versions of one key spread out.
    """
    if layout.is_nested(df):
        return flatten(latest(df, layout), layout)
    newest = df.groupBy(F.col(f"`{layout.key}`").alias("_key")).agg(F.max(_seq_value(layout)).alias("_seq"))
    same = F.col(f"`{layout.key}`").eqNullSafe(F.col("_key")) & _seq_value(layout).eqNullSafe(F.col("_seq"))
    return df.join(newest, same, "left_semi")


def lookup(df: DataFrame, layout: Layout, keys: DataFrame | list[str]) -> DataFrame:
    """The newest version of the asked keys, as value rows. The filter runs before versions are compared."""
    if isinstance(keys, DataFrame):
        wanted = df.join(keys.select(F.col(keys.columns[0]).alias(layout.key)).distinct(), layout.key, "left_semi")
    else:
        wanted = df.filter(F.col(f"`{layout.key}`").isin(list(keys)))
    return flatten(latest(wanted, layout), layout)


def with_previous(df: DataFrame, layout: Layout, chunk: Column | None = None, out: str = "previous_seq") -> DataFrame:
    """Add the ``seq`` of the version that each version replaced, null for the first one."""
    return with_neighbour(df, [layout.key], list(layout.seq), chunk, out, following=False)


def changelog(df: DataFrame, layout: Layout, chunk: Column | None = None) -> DataFrame:
    """Signed value rows: every version once with its numbers, once negated when a later version replaces it.

    ``applied_seq`` tells when the row takes effect. Summing the log gives the same cells as summing the newest
    versions. A version without points adds nothing and still retracts its predecessor. ``chunk`` rises with ``seq`` and tells
    how finely the versions of a key are spread; without it, chunks come from the data (see :func:`with_neighbour`).
    """
    next_seq = with_neighbour(df, [layout.key], list(layout.seq), chunk, "_next", following=True)
    own = F.col(f"`{layout.seq[0]}`") if len(layout.seq) == 1 else _seq_value(layout)
    entry = F.struct(own.alias("applied_seq"), F.lit(1).alias("sign"))
    undo = F.struct(F.col("_next").alias("applied_seq"), F.lit(-1).alias("sign"))
    steps = F.when(F.col("_next").isNull(), F.array(entry)).otherwise(F.array(entry, undo))
    kept = [c for c in df.columns]
    signed = next_seq.select(*[F.col(f"`{c}`") for c in kept], F.inline(steps))
    rows = flatten(signed, layout)
    return rows.withColumn(layout.value, F.when(F.col("sign") < 0, -F.col(layout.value)).otherwise(F.col(layout.value)))


def ever_seen(df: DataFrame, layout: Layout) -> DataFrame:
    """Newest value rows plus a zero row for every label tuple of any version.

    Summing it per cell gives what summing the change log gives, including cells that fell back to zero, without
    ordering the versions of a key.
    """
    names = [*layout.attributes]
    current = flatten(latest(df, layout), layout).select(*[F.col(f"`{n}`") for n in names], layout.value)
    tuples = flatten(df, layout).select(*[F.col(f"`{n}`") for n in names]).distinct()
    return current.unionByName(tuples.withColumn(layout.value, F.lit(0).cast(current.schema[layout.value].dataType)))


def counts(df: DataFrame, layout: Layout) -> DataFrame:
    """Versions received, keys stored, and value rows of the newest versions, as one row."""
    size = F.size(layout.points) if layout.is_nested(df) else F.lit(1)
    per_key = df.groupBy(F.col(f"`{layout.key}`")).agg(
        F.count(F.lit(1)).alias("versions"), F.max_by(size, _seq_value(layout)).alias("points")
    )
    return per_key.agg(
        F.sum("versions").cast("bigint").alias("versions"),
        F.count(F.lit(1)).alias("elements"),
        F.sum("points").cast("bigint").alias("points"),
    )
