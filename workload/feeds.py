"""The events as feeds that arrive bit by bit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.session import new_work_dir
from tallygrid.sources.feeds import stream_files
from tallygrid.streaming import live

from .inputs import EVENTS, MONEY, events

#: Parts that a feed arrives in, by the hour of the event; a missing time is in the first one.
PARTS = 3
BUCKETS = 256


def tasks(spark) -> int:
    """Tasks that share a feed's state: as many as run at once."""
    return max(2, spark.sparkContext.defaultParallelism)


def part_of(parts: int = PARTS):
    return F.coalesce(F.hour("ts"), F.lit(0)) % parts


class Arriving:
    """A table that reaches a feed part by part. The feed is stopped after every part and goes on from its checkpoint."""

    def __init__(self, spark, specs, layout=EVENTS, **options):
        self.spark, self.specs, self.layout, self.options = spark, list(specs), layout, options
        self.work = new_work_dir(spark, "arriving")
        self.feed = live.Feed(spark, f"{self.work}/feed")
        self.schema = None

    def give(self, part):
        """Let rows arrive and publish what they change."""
        self.schema = part.schema
        part.write.mode("append").parquet(f"{self.work}/in")
        source = stream_files(self.spark, f"{self.work}/in", part.schema)
        records = live.live_records(source, self.layout, self.specs, MONEY, fills=self.feed.fills(MONEY), buckets=BUCKETS, **self.options)
        self.feed.start(records, partitions=tasks(self.spark)).awaitTermination()


def fed(spark, sf, specs, layout=EVENTS, source=None, parts=2, **options):
    """The feed after all events have arrived in several parts, and what has fed it."""
    rows = events(spark, sf) if source is None else source
    arriving = Arriving(spark, specs, layout, **options)
    for part in range(parts):
        arriving.give(rows.filter(part_of(parts) == part))
    return arriving.feed, arriving


def shown(cells):
    """Attached cells with one label per side."""
    return cells.select("view", F.col("col_keys")[0].alias("col_key"), F.col("row_keys")[0].alias("row_key"), "is_total", "value")
