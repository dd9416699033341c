"""Order-dependent work without one task per group.

A plain window gives every group to one task. When a single group may hold a large part of all rows, that task
decides the run time. The helpers here cut groups into chunks that follow the order, work inside the chunks, and
hand a small summary from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

CHUNK_ROWS = 4096


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _order_value(order: list[str]) -> Column:
    return F.col(f"`{order[0]}`") if len(order) == 1 else F.struct(*_columns(order))


def _staged(df: DataFrame, group: list[str], order: list[str], chunk: Column | None) -> DataFrame:
    """Rows with ``_chunk``, which rises with the order inside a group."""
    if chunk is None:
        return ordered_chunks(df, [*group, *order]).drop("_at")
    return df.withColumn("_chunk", chunk)


def with_neighbour(df: DataFrame, group: list[str], order: list[str], chunk: Column | None, out: str,
                   following: bool = True) -> DataFrame:
    """Add the order value of the following (or preceding) row of the same group as ``out``.

    ``chunk`` must rise with the order, for example ``date_trunc('day', ts)`` when ordering by ``ts``. Rows are
    shuffled by (group, chunk), so a group is spread as finely as the chunks are. Without ``chunk`` all rows are sorted
    and cut every few thousand, so that no group, however its order values cluster, makes a large chunk; this costs
    a checkpoint of the rows. What passes between chunks is one order value per chunk.
    """
    staged = _staged(df, group, order, chunk)
    edge = _order_value(order)
    step = F.lead if following else F.lag
    edges = staged.groupBy(*_columns(group), "_chunk").agg(
        (F.min(edge) if following else F.max(edge)).alias("_edge")
    )
    carried = edges.select(
        *_columns(group),
        "_chunk",
        step("_edge").over(Window.partitionBy(*_columns(group)).orderBy("_chunk")).alias("_carried"),
    )
    inside = staged.withColumn(
        out, step(edge).over(Window.partitionBy(*_columns(group), "_chunk").orderBy(*_columns(order)))
    )
    joined = inside.join(carried, [*group, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_carried"))).drop("_chunk", "_carried")


def numbered(df: DataFrame, group: list[str], order: list[str], chunk: Column | None, out: str) -> DataFrame:
    """Add the 0-based position of each row in its group, by the same chunking as :func:`with_neighbour`."""
    staged = _staged(df, group, order, chunk)
    sizes = staged.groupBy(*_columns(group), "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*_columns(group)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*_columns(group), "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = staged.withColumn(
        out, F.row_number().over(Window.partitionBy(*_columns(group), "_chunk").orderBy(*_columns(order))) - 1
    )
    joined = inside.join(offsets, [*group, "_chunk"], "left")
    return joined.withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_chunk", "_before")


def ordered_chunks(df: DataFrame, order: list[str | Column], chunk_rows: int | None = None) -> DataFrame:
    """Sort all rows and add ``_at`` (rises with the order) and ``_chunk`` (at most ``chunk_rows`` rows each, ``CHUNK_ROWS`` by default).

    The rows are range-partitioned, so no task holds them all. The result is checkpointed: later steps read it
    more than once and must see one and the same numbering.
    """
    columns = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    marked = spread.withColumn("_at", F.monotonically_increasing_id())
    return checkpointed(marked.withColumn("_chunk", F.floor(F.col("_at") / F.lit(chunk_rows or CHUNK_ROWS)).cast("bigint")))


def with_index(chunks: DataFrame, group: list[str], out: str) -> DataFrame:
    """Add the 0-based position inside each group to the result of :func:`ordered_chunks`."""
    sizes = chunks.groupBy(*_columns(group), "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*_columns(group)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*_columns(group), "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = chunks.withColumn(
        out, F.row_number().over(Window.partitionBy(*_columns(group), "_chunk").orderBy("_at")) - 1
    )
    joined = inside.join(offsets, [*group, "_chunk"])
    return joined.withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_before")
