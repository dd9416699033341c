"""Running cell sums over a change log, and their publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import TOTAL_LABEL
from ..model import Layout
from ..operators.cells import labelled, summed
from ..operators.changes import cell_changes
from ..plans.spec import ViewSpec, total_sets

# The send interval in milliseconds, and the fastest rate.
TICK_MS = 150
FASTEST_RATE = 5


def rate_interval(rate: int) -> str | None:
    """Trigger interval for a publish rate: 0 pauses (None), 1 is slow, 5 and 4 are every tick."""
    if rate < 0 or rate > FASTEST_RATE:
        raise ValueError(f"rate {rate} is not within 0..{FASTEST_RATE}")
    return None if rate == 0 else f"{TICK_MS * max(1, FASTEST_RATE - rate)} milliseconds"


def cell_keys(spec: ViewSpec, keep: Sequence[str] = ()) -> list[str]:
    return [*keep, "level", *spec.columns]


def running_cells(log: DataFrame, layout: Layout, spec: ViewSpec, measure: str = "double", rule: str = "documented",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Sums of a change log per cell; works on streams (update mode) and on tables alike.

    ``level`` is 0 for base cells and numbers the kinds of total cells. Each value row enters its cell and its total
    cells, and every task sums its rows before the shuffle. Cells that fall back to zero stay. A transform needs whole elements,
    which a change log does not have, so views with one are refused; :func:`tallygrid.streaming.live.live_records` takes them.
    """
    if spec.transform is not None:
        raise ValueError(f"view {spec.name}: a change log cannot be transformed")
    rows = labelled(log, layout, spec, measure, keep)
    variants = []
    for level, kept in enumerate([tuple(range(len(spec.axes))), *total_sets(spec, rule)]):
        labels = [
            (F.col(f"`{c}`") if i in kept else F.lit(TOTAL_LABEL)).alias(c) for i, c in enumerate(spec.columns)
        ]
        variants.append(F.struct(F.lit(level).alias("level"), *labels))
    keys = [F.col(f"`{k}`") for k in cell_keys(spec, keep)]
    spread = rows.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(*variants)), "value")
    sums = spread.groupBy(*keys).agg(summed(measure))
    hidden = (F.col("level") == 0) & F.lit(spec.is_hidden)
    value = F.col("value") if measure == "double" else F.col("value").cast("double")
    return sums.select(*keys, value.alias("value"), (F.col("level") > 0).alias("is_total"), hidden.alias("hidden"))


def run_updates(cells: DataFrame, feed: str, checkpoint: str, rate: int | None = None) -> StreamingQuery | None:
    """Publish changed visible cells, one folder per micro-batch. Without ``rate``, run over what is there and end.

    A repeated micro-batch replaces its own folder, so nothing is published twice. A rate of 0 starts nothing:
    pausing is stopping, and the checkpoint resumes.
    """
    if rate == 0:
        return None

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{feed}/batch={number}")

    writer = (
        cells.filter(~F.col("hidden")).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    if rate is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=rate_interval(rate)).start()


def snapshot(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of every cell of an update feed, for a consumer that attaches or has lost track."""
    rest = [c for c in feed.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("batch"))
    grouped = feed.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(newest.alias("_newest"))
    return grouped.select(*[F.col(f"`{k}`") for k in keys], "_newest.*")


def compact(spark: SparkSession, feed: str, states: str, keys: list[str]) -> int:
    """Fold the micro-batches published since the last call into a new full state, and return its last batch.

    Reads the newest state and only the newer folders of the feed; both are partition-pruned. Without any micro-batch
    there is no state to write, and the result is -1.
    """
    before = _newest_state(spark, states)
    after = _table(spark, feed)
    if after is not None and before is not None:
        after = after.filter(F.col("batch") > before[0])
    last = None if after is None else after.agg(F.max("batch")).first()[0]
    if last is None:
        return -1 if before is None else before[0]
    merged = after if before is None else before[1].unionByName(after)
    snapshot(merged, keys).write.mode("overwrite").parquet(f"{states}/batch={last}")
    return last


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A folder of micro-batches, or None as long as it is missing or holds none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _newest_state(spark: SparkSession, states: str) -> tuple[int, DataFrame] | None:
    found = _table(spark, states)
    if found is None:
        return None
    last = found.agg(F.max("batch")).first()[0]
    return None if last is None else (last, found.filter(F.col("batch") == last))


def current_state(spark: SparkSession, feed: str, states: str, keys: list[str]) -> DataFrame:
    """What a consumer gets on attaching: the newest full state, brought up to date with the feed after it.

    A feed without any micro-batch has no columns yet and is refused; :class:`tallygrid.streaming.live.Feed` serves consumers that come that early.
    """
    after, before = _table(spark, feed), _newest_state(spark, states)
    if after is None and before is None:
        raise ValueError(f"nothing is published in {feed}")
    if after is None:
        return snapshot(before[1], keys)
    if before is None:
        return snapshot(after, keys)
    return snapshot(before[1].unionByName(after.filter(F.col("batch") > before[0])), keys)


def closed_epochs(cells: DataFrame, epoch: str) -> DataFrame:
    """All epochs but the last one, which is still open."""
    epochs = cells.select(epoch).distinct()
    return epochs.join(epochs.agg(F.max(epoch).alias("_open")), F.col(epoch) < F.col("_open")).select(epoch)


def epoch_changes(cells: DataFrame, keys: list[str], epoch: str, closed: DataFrame | None = None) -> DataFrame:
    """Updates and deletes that each closed epoch brings over the one before it.

    A reset opens an epoch. Nothing of an epoch is published while it is open; with ``closed`` (a table of epochs)
    only those count. A cell that the new epoch does not have is deleted.
    """
    if closed is not None:
        cells = cells.join(closed.select(epoch).distinct(), epoch, "left_semi")
    epochs = cells.select(epoch).distinct()
    following = epochs.select(epoch, F.lead(epoch).over(Window.orderBy(epoch)).alias("_following"))
    earlier = cells.join(following.filter(F.col("_following").isNotNull()), epoch)
    earlier = earlier.withColumn(epoch, F.col("_following")).drop("_following")
    return cell_changes(earlier, cells, [epoch, *keys])
