"""The continuous forms, run over what is there and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions.display import accounting
from tallygrid.operators.elements import flatten
from tallygrid.operators.store import latest
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import all_views
from tallygrid.session import checkpointed, new_work_dir
from tallygrid.sources.feeds import stream_files
from tallygrid.streaming import cells as sc
from tallygrid.streaming import upsert

from .feeds import fed
from .inputs import EVENTS, EVENTS_SQL, MONEY, PAIRS, PAIRS_SQL, pairs, table, total
from .registry import query
from .store_queries import NEWEST_SQL


def _feed(spark, sf, *more):
    """The events as a stream of versions."""
    schema = table(spark, sf, "events").schema
    source = stream_files(spark, f"{sf}/events.parquet", schema)
    day = F.to_date("ts").cast("string").alias("DAY")
    return source.select("user_id", "ts", "event_id", "event_type", day, "value", *more)


def _log(spark, sf, source=None, epoch=None, layout=EVENTS):
    """Run the change log to a table and return it."""
    work = new_work_dir(spark, "changelog")
    log = upsert.changelog_stream(_feed(spark, sf) if source is None else source, layout, epoch)
    upsert.run_changelog(log, f"{work}/log", f"{work}/checkpoint").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{work}/log"), f"{work}/log"


def _published(spark, path, schema, spec, layout=EVENTS, rule="documented", keep=()):
    """Run the sums over a change log and return the newest state of the published cells."""
    work = new_work_dir(spark, "cells")
    log = stream_files(spark, path, schema)
    cells = sc.running_cells(log, layout, spec, MONEY, rule, keep)
    sc.run_updates(cells, f"{work}/feed", f"{work}/checkpoint").awaitTermination()
    return sc.snapshot(spark.read.parquet(f"{work}/feed"), sc.cell_keys(spec, keep))


@query(f"""
SELECT user_id, ts, event_id, event_type, DAY, sign, sign * value AS value
FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM ({EVENTS_SQL})) e,
LATERAL (SELECT unnest([1, -1]) AS sign) s
WHERE sign = 1 OR following IS NOT NULL
""")
def stream_upsert(spark, sf):
    log, _ = _log(spark, sf)
    return log


DAYS = ViewSpec("days", rows=("event_type",), cols=("DAY",))


@query(f"""
SELECT DAY, event_type, {total('value')} FROM (
  SELECT DAY, event_type, value FROM ({NEWEST_SQL})
  UNION ALL SELECT DISTINCT DAY, event_type, 0.0 FROM ({EVENTS_SQL}))
GROUP BY ALL
""")
def stream_cells(spark, sf):
    log, path = _log(spark, sf)
    return _published(spark, path, log.schema, DAYS).select("DAY", "event_type", "value")


INSERTS = ViewSpec("inserts", rows=("event_type",), cols=("DAY",), totals=("event_type", "DAY"),
                   filters={"event_type": ("click", "view", "purchase")})


@query(f"""
SELECT CASE WHEN GROUPING(DAY) = 1 THEN 'Total' ELSE DAY END AS DAY,
       CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS event_type,
       GROUPING(DAY) + GROUPING(event_type) > 0 AS is_total, {total('value')}
FROM ({EVENTS_SQL}) WHERE event_type IN ('click', 'view', 'purchase')
GROUP BY GROUPING SETS ((DAY, event_type), (DAY), (event_type), ())
""")
def stream_totals(spark, sf):
    """An insert-only feed needs no state per key; the sums read it directly."""
    work = new_work_dir(spark, "totals")
    cells = sc.running_cells(_feed(spark, sf), EVENTS, INSERTS, MONEY)
    sc.run_updates(cells, f"{work}/feed", f"{work}/checkpoint").awaitTermination()
    state = sc.snapshot(spark.read.parquet(f"{work}/feed"), sc.cell_keys(INSERTS))
    return state.select("DAY", "event_type", "is_total", "value")


@query(f"""
SELECT event_type, {total('value')} FROM events GROUP BY ALL
""")
def stream_snapshot(spark, sf):
    """What a consumer gets on attaching: the feed folded into a full state."""
    work = new_work_dir(spark, "attach")
    spec = ViewSpec("types", rows=("event_type",))
    cells = sc.running_cells(_feed(spark, sf), EVENTS, spec, MONEY)
    sc.run_updates(cells, f"{work}/feed", f"{work}/checkpoint").awaitTermination()
    keys = sc.cell_keys(spec)
    sc.compact(spark, f"{work}/feed", f"{work}/states", keys)
    return sc.current_state(spark, f"{work}/feed", f"{work}/states", keys).select("event_type", "value")


@query(f"""
SELECT event_type, {total('value')} FROM (
  SELECT event_type, CASE WHEN gone THEN 0 ELSE value END AS value
  FROM (SELECT *, event_type = 'error' AS gone FROM ({NEWEST_SQL}))
  WHERE NOT gone
  UNION ALL SELECT DISTINCT event_type, 0.0 FROM events WHERE event_type <> 'error')
GROUP BY ALL
""")
def stream_delete(spark, sf):
    """An error event deletes its user: it arrives without points."""
    nested = EVENTS.with_(core=("event_type", "DAY"), perimeter=("KIND",))
    points = F.when(F.col("event_type") != "error", F.array(
        F.struct(F.lit(None).cast("string").alias("KIND"), F.col("value")))).otherwise(
        F.array().cast("array<struct<KIND: string, value: double>>"))
    source = _feed(spark, sf).withColumn("points", points).drop("value")
    log, path = _log(spark, sf, source, layout=nested)
    spec = ViewSpec("left", rows=("event_type",))
    return _published(spark, path, log.schema, spec, nested).select("event_type", "value")


EPOCH_SQL = f"""
  SELECT *, CAST((day(ts) - 1) // 10 AS BIGINT) AS epoch FROM ({EVENTS_SQL})
"""

EPOCH_CELLS_SQL = f"""
  SELECT epoch, event_type, DAY, {total('value')} FROM (
    SELECT epoch, event_type, DAY, value FROM ({EPOCH_SQL})
    QUALIFY row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts DESC, event_id DESC) = 1
    UNION ALL SELECT DISTINCT epoch, event_type, DAY, 0.0 FROM ({EPOCH_SQL}))
  GROUP BY ALL
"""


def _epochs(spark, sf):
    """Every ten days the feed starts over; cells are kept per epoch."""
    epoch = F.floor((F.dayofmonth("ts") - 1) / 10).cast("bigint").alias("epoch")
    log, path = _log(spark, sf, _feed(spark, sf, epoch), epoch="epoch")
    return _published(spark, path, log.schema, DAYS, keep=("epoch",))


@query(EPOCH_CELLS_SQL)
def stream_epoch(spark, sf):
    return _epochs(spark, sf).select("epoch", "event_type", "DAY", "value")


@query(f"""
WITH e AS ({EPOCH_CELLS_SQL}), c AS (SELECT * FROM e WHERE epoch < (SELECT max(epoch) FROM e)), p AS (SELECT epoch + 1 AS epoch, event_type, DAY, value FROM c WHERE epoch < (SELECT max(epoch) FROM c))
SELECT COALESCE(c.epoch, p.epoch) AS epoch, COALESCE(c.event_type, p.event_type) AS event_type,
       COALESCE(c.DAY, p.DAY) AS DAY, CASE WHEN c.epoch IS NULL THEN 'DEL' ELSE 'UPD' END AS command,
       p.value AS before, c.value AS value
FROM c FULL JOIN p ON c.epoch = p.epoch AND c.event_type = p.event_type AND c.DAY = p.DAY
WHERE c.epoch IS NULL OR p.epoch IS NULL OR c.value <> p.value
""")
def stream_epoch_changes(spark, sf):
    """What each closed epoch brings: updates, and deletes of cells it no longer has. The last epoch is still open."""
    cells = checkpointed(_epochs(spark, sf))
    changes = sc.epoch_changes(cells, ["event_type", "DAY"], "epoch", sc.closed_epochs(cells, "epoch"))
    return changes.drop("is_total")


@query(f"""
SELECT 'types' AS view, event_type AS label, {total('value')} FROM ({NEWEST_SQL}) GROUP BY ALL
UNION ALL
SELECT 'days' AS view, DAY AS label, {total('value')} FROM ({NEWEST_SQL}) GROUP BY ALL
""")
def stream_rebuild(spark, sf):
    """New definitions are filled with the newest versions in the change log that the stream has written."""
    log, _ = _log(spark, sf)
    specs = (ViewSpec("types", rows=("event_type",)), ViewSpec("days", rows=("DAY",)))
    newest = latest(log.filter("sign > 0").drop("sign"), EVENTS)
    return all_views(newest, EVENTS, specs, MONEY).select("view", F.col("row_keys")[0].alias("label"), "value")


PAIR_VIEW = ViewSpec("pairs", rows=("event_type",), cols=("METRIC",))


@query(f"""
SELECT METRIC, event_type, {total('value')} FROM (
  SELECT METRIC, event_type, value FROM ({PAIRS_SQL})
  QUALIFY rank() OVER (PARTITION BY pair_key ORDER BY ts DESC, event_id DESC) = 1
  UNION ALL SELECT DISTINCT METRIC, event_type, 0.0 FROM ({PAIRS_SQL}))
GROUP BY ALL
""")
def stream_upsert_flat(spark, sf):
    """Versions that arrive as one row per point: none of a version's points is lost."""
    work = new_work_dir(spark, "pairs")
    flatten(pairs(spark, sf), PAIRS).select("pair_key", "ts", "event_id", "event_type", "METRIC", "SIZE", "value").write.parquet(f"{work}/in")
    rows = spark.read.parquet(f"{work}/in")
    log, path = _log(spark, sf, stream_files(spark, f"{work}/in", rows.schema), layout=PAIRS)
    return _published(spark, path, log.schema, PAIR_VIEW, PAIRS).select("METRIC", "event_type", "value")


MESSAGES = ViewSpec("types", rows=("event_type",), cols=("DAY",), totals=("event_type",))


@query(f"""
SELECT 'types' AS "viewName", 'UPD' AS command, CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS row_key,
       DAY AS col_key, format('{{:,}}', CAST(round_even(SUM(CAST(value AS DECIMAL(18,2))), 0) AS BIGINT)) AS value
FROM ({EVENTS_SQL}) GROUP BY GROUPING SETS ((DAY, event_type), (DAY))
""")
def stream_messages(spark, sf):
    """Change records of a feed that arrives in several micro-batches; the last record of each cell tells its number.

    Every event is an element of its own here, so the feed's sums are those of all events."""
    own = EVENTS.with_(key="event_id", seq=("ts",))
    feed, _ = fed(spark, sf, [MESSAGES], own)
    newest = feed.records().groupBy("view", "col_keys", "row_keys").agg(F.max_by(F.struct("command", "value"), "batch").alias("n"))
    return newest.select(
        F.col("view").alias("viewName"), "n.command", F.col("row_keys")[0].alias("row_key"), F.col("col_keys")[0].alias("col_key"), accounting(F.col("n.value")).alias("value")
    )
