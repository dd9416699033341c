"""Feeds of change records: many views, baselines, transforms, epochs, attaching and added views, each compared with SQL over the whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tallygrid.operators import elements as el
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import register_transform
from tallygrid.session import new_work_dir, ship
from tallygrid.sources.feeds import stream_files
from tallygrid.sources.push import Producer, pushed
from tallygrid.streaming import live, upsert

from .feeds import BUCKETS, Arriving, fed, part_of, shown, tasks
from .inputs import EVENTS, EVENTS_SQL, MONEY, PAIRS, PAIRS_SQL, events, pairs, total
from .registry import query
from .store_queries import BASELINE_VIEW, NEWEST_SQL

register_transform("only clicks", lambda df, layout: df.filter(F.col("event_type") == "click"))

# A cell that elements have left stays with zero. Which of them a feed has seen depends on what came late, so cells of zero are not compared.
NOT_ZERO = "HAVING SUM(CAST(value AS DECIMAL(18,2))) <> 0"

TYPES = ViewSpec("types", rows=("event_type",), cols=("DAY",), totals=("event_type",))
DAYS = ViewSpec("days", rows=("DAY",), filters={"event_type": ("click", "view")})
ACTIONS = ViewSpec("actions", rows=("event_type",), renames={"event_type": {"click": "visit", "view": "visit"}})

ACTS = ViewSpec("acts", rows=("event_type",))

TYPES_SQL = f"""
SELECT 'types' AS view, DAY AS col_key, CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS row_key,
       GROUPING(event_type) = 1 AS is_total, {total('value')}
FROM ({NEWEST_SQL}) GROUP BY GROUPING SETS ((DAY, event_type), (DAY)) {NOT_ZERO}
"""

DAYS_SQL = f"""
SELECT 'days' AS view, '' AS col_key, DAY AS row_key, false AS is_total, {total('value')} FROM ({NEWEST_SQL}) WHERE event_type IN ('click', 'view') GROUP BY ALL {NOT_ZERO}
"""


@query(f"""
{TYPES_SQL} UNION ALL {DAYS_SQL} UNION ALL
SELECT 'actions' AS view, '' AS col_key, CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE event_type END AS row_key, false AS is_total,
       {total('value')} FROM ({NEWEST_SQL}) GROUP BY ALL {NOT_ZERO}
""")
def stream_multi_view(spark, sf):
    """Three views on one stream of versions, with one state for all sums."""
    feed, _ = fed(spark, sf, [TYPES, DAYS, ACTIONS])
    return shown(feed.attach()[0].filter("value <> 0"))


@query(f"""
WITH first AS (SELECT * FROM ({PAIRS_SQL}) QUALIFY rank() OVER (PARTITION BY pair_key ORDER BY ts, event_id) = 1),
last AS (SELECT * FROM ({PAIRS_SQL}) QUALIFY rank() OVER (PARTITION BY pair_key ORDER BY ts DESC, event_id DESC) = 1),
newest AS (SELECT event_type, METRIC, SIZE, value FROM last UNION ALL SELECT event_type, METRIC, SIZE, value FROM first
           UNION ALL SELECT event_type, METRIC, SIZE, -value FROM first)
SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS event_type, METRIC, COALESCE(SIZE, '-') AS SIZE,
       GROUPING(event_type) = 1 AS is_total, {total('value')}
FROM newest GROUP BY GROUPING SETS ((event_type, METRIC, SIZE), (METRIC, SIZE)) HAVING SUM(CAST(value AS DECIMAL(18,2))) <> 0
""")
def stream_baseline(spark, sf):
    """Differences against baselines that change as well: the first event of every pair, sent as a baseline in each part, and the pair's events."""
    source = pairs(spark, sf)
    first = source.groupBy("pair_key").agg(F.min_by(F.struct(*[c for c in source.columns if c != "pair_key"]), F.struct("ts", "event_id")).alias("first")).select("pair_key", "first.*")
    wrong = F.transform("points", lambda p: p.withField("value", p["value"] + 1))
    arriving = Arriving(spark, [BASELINE_VIEW], PAIRS)
    arriving.give(source.filter(part_of() == 0))
    early = first.withColumn("points", wrong).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    for part, baselines in ((1, early), (2, first)):
        arriving.give(source.filter(part_of() == part).unionByName(el.copied(baselines, PAIRS, key=F.concat("pair_key", F.lit("-SOD")))))
    # A baseline is an element too, so both sides of the pairs are in the view.
    cells = arriving.feed.attach()[0].filter("value <> 0")
    return cells.select(F.col("col_keys")[0].alias("event_type"), F.col("row_keys")[0].alias("METRIC"), F.col("row_keys")[1].alias("SIZE"), "is_total", "value")


@query(f"""
SELECT 'doubled' AS view, event_type AS row_key, {total('value * 2')} FROM ({NEWEST_SQL}) GROUP BY ALL
UNION ALL SELECT 'clicks' AS view, DAY AS row_key, {total('value')} FROM ({NEWEST_SQL}) WHERE event_type = 'click' GROUP BY ALL
UNION ALL SELECT 'all' AS view, event_type AS row_key, {total('value')} FROM ({NEWEST_SQL}) GROUP BY ALL
""")
def stream_transform(spark, sf):
    """Views with transforms on a live feed: one changes numbers, one drops elements, which then leave the cells they were in."""
    specs = [
        ViewSpec("doubled", rows=("event_type",), transform="scaled", transform_arg="2.0"), ViewSpec("clicks", rows=("DAY",), transform="only clicks"),
        ViewSpec("all", rows=("event_type",)),
    ]
    feed, _ = fed(spark, sf, specs)
    return feed.attach()[0].filter("value <> 0").select("view", F.col("row_keys")[0].alias("row_key"), "value")


EPOCHS_SQL = f"""
  SELECT *, CAST(hour(ts) % 3 AS BIGINT) AS epoch FROM ({EVENTS_SQL})
"""

CLOSED_SQL = f"""
  SELECT epoch, event_type, DAY, {total('value')} FROM (
    SELECT epoch, event_type, DAY, value FROM ({EPOCHS_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts DESC, event_id DESC) = 1
    UNION ALL SELECT DISTINCT epoch, event_type, DAY, 0.0 FROM ({EPOCHS_SQL}))
  WHERE epoch < 2 GROUP BY ALL
"""


@query(f"""
WITH c AS ({CLOSED_SQL}), p AS (SELECT epoch + 1 AS epoch, event_type, DAY, value FROM c WHERE epoch = 0)
SELECT COALESCE(c.epoch, p.epoch) AS epoch, COALESCE(c.event_type, p.event_type) AS event_type, COALESCE(c.DAY, p.DAY) AS DAY,
       CASE WHEN c.epoch IS NULL THEN 'DEL' ELSE 'UPD' END AS command, p.value AS before, c.value AS value
FROM c FULL JOIN p ON c.epoch = p.epoch AND c.event_type = p.event_type AND c.DAY = p.DAY
WHERE c.epoch IS NULL OR p.epoch IS NULL OR c.value <> p.value
""")
def stream_epoch_close(spark, sf):
    """Four micro-batches: two epochs that close, one with its marker only afterwards, and one that stays open and publishes nothing."""
    rows = events(spark, sf).withColumn("epoch", part_of().cast("bigint")).withColumn("mark", F.lit(None).cast("string"))

    def marker(epoch, kind):
        return spark.createDataFrame([(epoch, kind)], "epoch bigint, mark string")

    arriving = Arriving(spark, [ViewSpec("days", rows=("event_type",), cols=("DAY",))], epoch="epoch", marker="mark")
    arriving.give(rows.filter("epoch = 0").unionByName(marker(0, live.CLOSE), allowMissingColumns=True))
    arriving.give(rows.filter("epoch = 1").unionByName(marker(1, live.OPEN), allowMissingColumns=True))
    arriving.give(rows.limit(0).unionByName(marker(1, live.CLOSE), allowMissingColumns=True))
    arriving.give(rows.filter("epoch = 2").unionByName(marker(2, live.OPEN), allowMissingColumns=True))
    epoch = F.when(F.col("batch") == 0, 0).when(F.col("batch") == 2, 1).otherwise(F.col("batch") + 100).cast("bigint")
    return arriving.feed.records().select(epoch.alias("epoch"), F.col("row_keys")[0].alias("event_type"), F.col("col_keys")[0].alias("DAY"), "command", "before", "value")


@query(f"""
SELECT 'before' AS moment, CAST(-1 AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS row_key, CAST(NULL AS DOUBLE) AS value
UNION ALL SELECT 'after', CAST(2 AS BIGINT), DAY, {total('value')} FROM ({NEWEST_SQL}) WHERE event_type IN ('click', 'view') GROUP BY ALL {NOT_ZERO}
UNION ALL SELECT 'followed', CAST(2 AS BIGINT), DAY, {total('value')} FROM ({NEWEST_SQL}) WHERE event_type IN ('click', 'view') GROUP BY ALL {NOT_ZERO}
""")
def stream_attach(spark, sf):
    """Consumers that attach before the first micro-batch, at the end, and after the first part, who then follow the records."""
    arriving = Arriving(spark, [DAYS])
    nothing, before = arriving.feed.attach()
    rows = events(spark, sf)
    arriving.give(rows.filter(part_of() == 0))
    arriving.feed.compact()
    early, at = arriving.feed.attach()
    early = early.select("row_keys", "value").withColumn("batch", F.lit(at).cast("bigint"))
    early.write.parquet(f"{arriving.work}/early")
    for part in (1, 2):
        arriving.give(rows.filter(part_of() == part))
    work = new_work_dir(spark, "followed")
    arriving.feed.tail(at).select("row_keys", "value", "batch").writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").trigger(
        availableNow=True).start(f"{work}/rows").awaitTermination()
    told = spark.read.parquet(f"{arriving.work}/early").unionByName(spark.read.schema("row_keys array<string>, value double, batch bigint").parquet(f"{work}/rows"))
    followed = told.groupBy("row_keys").agg(F.max_by("value", "batch").alias("value"))
    arriving.feed.compact()
    after, last = arriving.feed.attach()

    def moment(name, position, cells):
        return cells.select(F.lit(name).alias("moment"), F.lit(position).cast("bigint").alias("position"), F.col("row_keys")[0].alias("row_key"), "value")

    first = spark.createDataFrame([("before", before, None, None)], "moment string, position bigint, row_key string, value double")
    return first.unionByName(moment("before", before, nothing)).unionByName(moment("after", last, after.filter("value <> 0"))).unionByName(moment("followed", last, followed.filter("value <> 0")))


@query(f"""
{TYPES_SQL} UNION ALL {DAYS_SQL}
""")
def stream_added_view(spark, sf):
    """A view that joins a running feed: filled from the feed's state after two parts, it follows the stream from there."""
    arriving = Arriving(spark, [TYPES])
    rows = events(spark, sf)
    for part in (0, 1):
        arriving.give(rows.filter(part_of() == part))
    arriving.feed.add_view(DAYS, rows, EVENTS, arriving.specs, MONEY)
    arriving.specs.append(DAYS)
    arriving.give(rows.filter(part_of() == 2))
    return shown(arriving.feed.attach()[0].filter("value <> 0"))


@query("""
SELECT CAST(hour(ts) % 3 AS BIGINT) AS batch, COUNT(*) AS versions, COUNT(*) AS points, CAST(0 AS BIGINT) AS deletions FROM events GROUP BY ALL
""")
def stream_counters(spark, sf):
    """What a listener counts per micro-batch."""
    counters = live.Counters()
    spark.streams.addListener(counters)
    try:
        arriving = Arriving(spark, [DAYS])
        rows = events(spark, sf)
        for part in range(3):
            rows.filter(part_of() == part).write.mode("append").parquet(f"{arriving.work}/in")
            source = live.counted(stream_files(spark, f"{arriving.work}/in", rows.schema), EVENTS)
            query_ = arriving.feed.start(live.live_records(source, EVENTS, [DAYS], MONEY, buckets=BUCKETS), partitions=tasks(spark))
            query_.awaitTermination()
            counters.wait_for(query_)
    finally:
        spark.streams.removeListener(counters)
    found = [(number, c["versions"], c["points"], c["deletions"]) for (_, number), c in counters.batches.items()]
    return spark.createDataFrame(found, "batch bigint, versions bigint, points bigint, deletions bigint")


@query(f"""
SELECT coalesce(user_id, -1) AS user_id, event_type, value FROM (
  SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE ts END AS ts, event_id, event_type, value FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1
""")
def stream_missing_keys(spark, sf):
    """Flat versions without a key or a time, every one of them sent twice: a missing key is a key, a missing time is the earliest, and nothing counts twice."""
    rows = events(spark, sf).withColumn("ts", F.when(F.col("user_id") % 7 != 0, F.col("ts"))).withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    work = new_work_dir(spark, "missing")
    for part in (0, 1):
        rows.write.mode("append").parquet(f"{work}/in")
        log = upsert.changelog_stream(stream_files(spark, f"{work}/in", rows.schema), EVENTS, buckets=BUCKETS)
        upsert.run_changelog(log, f"{work}/log", f"{work}/checkpoint").awaitTermination()
    left = spark.read.schema(log.schema).parquet(f"{work}/log").groupBy("user_id", "ts", "event_id", "event_type").agg(
        F.sum("sign").alias("sign"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return left.filter("sign <> 0").select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "event_type", "value")


@query(f"""
SELECT event_type, COUNT(*) AS elements, COUNT(DISTINCT event_id) AS different, {total('value')} FROM events GROUP BY ALL
""")
def stream_push(spark, sf):
    """Events pushed by many producers, one per task, and taken up by a stream that is stopped in between."""
    folder = new_work_dir(ship(spark), "push")
    spool = f"{folder}/spool"
    rows = events(spark, sf).select("event_id", "event_type", "value")
    schema = rows.schema

    def sender(part):
        def send(batches):
            producer = Producer(spool, schema, lane=f"{part}-{TaskContext.get().partitionId()}", first=0)
            for batch in batches:
                producer.push(batch)
            yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

        return send

    for part in range(2):
        events(spark, sf).filter(part_of(2) == part).select(*rows.columns).mapInArrow(sender(part), "done int").agg(F.sum("done")).collect()
        taken = pushed(spark, spool, rows.schema).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        taken.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("elements"), F.countDistinct("event_id").alias("different"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")
    )


@query(f"""
SELECT event_type, true AS bounded, {total('value')} FROM ({NEWEST_SQL}) GROUP BY ALL {NOT_ZERO}
""")
def stream_paced(spark, sf):
    """A feed at a rate, in micro-batches of at most one file, that is paused and goes on at another rate."""
    arriving = Arriving(spark, [ACTS])
    rows = events(spark, sf)

    def records():
        source = stream_files(spark, f"{arriving.work}/in", rows.schema, max_files=1).repartition(tasks(spark))
        return live.live_records(source, EVENTS, [ACTS], MONEY, buckets=BUCKETS)

    rows.filter(part_of(2) == 0).repartition(2).write.mode("append").parquet(f"{arriving.work}/in")
    running = arriving.feed.start(records(), 5, tasks(spark))
    running.processAllAvailable()
    paused = arriving.feed.change_rate(running, records(), 0)
    rows.filter(part_of(2) == 1).write.mode("append").parquet(f"{arriving.work}/in")
    running = arriving.feed.change_rate(paused, records(), 4)
    running.processAllAvailable()
    arriving.feed.change_rate(running, records(), 0)
    cells, position = arriving.feed.attach()
    return cells.filter("value <> 0").select(F.col("row_keys")[0].alias("event_type"), F.lit(position >= 2).alias("bounded"), "value")
