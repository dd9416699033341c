import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.model import Layout
from tallygrid.operators import elements as el
from tallygrid.operators import store as st
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import view_cells
from tallygrid.session import new_work_dir
from tallygrid.sources.feeds import stream_files
from tallygrid.streaming import cells as sc
from tallygrid.streaming import upsert

LAYOUT = Layout(core=("CCY",), perimeter=("METRIC", "TENOR"), seq=("at", "seq"))
SCHEMA = (
    "invariant_key string, at timestamp_ntz, seq long, CCY string, epoch int, "
    "points array<struct<METRIC: string, TENOR: string, value: double>>"
)


def versions(count, hot=0.4, seed=2, epochs=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(20)}"
        points = [] if rng.random() < 0.1 else [
            ("m", rng.choice(["x", None]), rng.randrange(100) / 4), ("n", "y", rng.randrange(100) / 4)
        ]
        rows.append((key, i, rng.choice(["USD", "CAD"]), i * epochs // count, points))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(
        rows, "invariant_key string, seq long, CCY string, epoch int, "
        "points array<struct<METRIC: string, TENOR: string, value: double>>"
    )
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq")).cast("timestamp_ntz")
    return df.select("invariant_key", at.alias("at"), "seq", "CCY", "epoch", "points")


def run(spark, batches, epoch=None):
    """The change log after feeding the batches one by one, restarting the query for each."""
    work = new_work_dir(spark, "test")
    for rows in batches:
        random.Random(1).shuffle(rows)
        frame(spark, rows).coalesce(2).write.mode("append").parquet(f"{work}/in")
        source = stream_files(spark, f"{work}/in", SCHEMA)
        log = upsert.changelog_stream(source, LAYOUT, epoch)
        upsert.run_changelog(log, f"{work}/log", f"{work}/cp").awaitTermination()
    return spark.read.parquet(f"{work}/log"), f"{work}/log"


@pytest.mark.parametrize("cuts", [[0, 300], [0, 50, 51, 200, 300]])
def test_stream_log_equals_batch_log(spark, cuts):
    rows = versions(300)
    log, _ = run(spark, [rows[a:b] for a, b in zip(cuts, cuts[1:])])
    batch = st.changelog(frame(spark, versions(300)), LAYOUT, F.floor(F.col("seq") / 40))
    columns = ["invariant_key", "at", "seq", "CCY", "sign", "pos", "METRIC", "TENOR", "value"]
    assert tuples(log, *columns) == tuples(batch.drop("epoch"), *columns)


def test_late_versions_are_dropped(spark):
    newer = ("a", 5, "USD", 0, [("m", None, 1.0)])
    older = ("a", 3, "USD", 0, [("m", None, 9.0)])
    same = ("a", 5, "USD", 0, [("m", None, 7.0)])
    log, _ = run(spark, [[newer], [older, same]])
    assert tuples(log, "seq", "value") == [(5, 1.0)]


def test_an_empty_version_deletes(spark):
    log, path = run(spark, [[("a", 1, "USD", 0, [("m", "x", 2.0)])], [("a", 2, "USD", 0, [])], [("a", 3, "USD", 0, [("m", "x", 4.0)])]])
    assert tuples(log, "seq", "value") == [(1, -2.0), (1, 2.0), (3, 4.0)]


def published(spark, path, schema, spec, keep=(), measure="double", steps=1):
    work = new_work_dir(spark, "published")
    for _ in range(steps):
        cells = sc.running_cells(stream_files(spark, path, schema), LAYOUT, spec, measure, keep=keep)
        sc.run_updates(cells, f"{work}/feed", f"{work}/cp").awaitTermination()
    return sc.snapshot(spark.read.parquet(f"{work}/feed"), sc.cell_keys(spec, keep))


def test_running_cells_and_totals(spark):
    rows = versions(200)
    log, path = run(spark, [rows[:120], rows[120:]])
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY", "METRIC"), totals=("TENOR", "CCY"))
    live = published(spark, path, log.schema, spec, measure="fixed(2)")
    batch = view_cells(st.latest(frame(spark, versions(200)), LAYOUT), LAYOUT, spec, "fixed(2)")
    names = [*spec.columns, "value", "is_total"]
    assert [t for t in tuples(live, *names) if t[-2] != 0] == [t for t in tuples(batch, *names) if t[-2] != 0]
    table = sc.running_cells(log, LAYOUT, spec, "fixed(2)")
    assert tuples(table, "level", *names) == tuples(live, "level", *names)


def test_hidden_cells_are_not_published(spark):
    log, path = run(spark, [versions(50)])
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY",), totals=("TENOR",), hide=("TENOR",))
    live = published(spark, path, log.schema, spec)
    assert {r["TENOR"] for r in live.collect()} == {"Total"}


def test_epochs(spark):
    rows = versions(200, epochs=3)
    log, path = run(spark, [rows[:90], rows[90:]], epoch="epoch")
    newest = st.latest(frame(spark, versions(200, epochs=3)), LAYOUT, per=("epoch",))
    expected = el.flatten(newest, LAYOUT).groupBy("epoch", "CCY").agg(F.sum("value").alias("value"))
    found = log.groupBy("epoch", "CCY").agg(F.sum("value").alias("value"))
    assert tuples(found) == tuples(expected)
    spec = ViewSpec("v", rows=("CCY",))
    cells = published(spark, path, log.schema, spec, keep=("epoch",))
    assert tuples(cells, "epoch", "CCY", "value") == tuples(expected, "epoch", "CCY", "value")


def test_epoch_changes(spark):
    cells = spark.createDataFrame(
        [(0, "a", 1.0), (0, "b", 2.0), (2, "a", 1.0), (2, "c", 3.0), (5, "c", 4.0)], "epoch int, k string, value double"
    )
    found = sc.epoch_changes(cells, ["k"], "epoch")
    assert tuples(found, "epoch", "k", "command") == [
        (0, "a", "UPD"), (0, "b", "UPD"), (2, "b", "DEL"), (2, "c", "UPD"), (5, "a", "DEL"), (5, "c", "UPD")
    ]
    closed = spark.createDataFrame([(0,), (2,)], "epoch int")
    assert {r["epoch"] for r in sc.epoch_changes(cells, ["k"], "epoch", closed).collect()} == {0, 2}


def test_compacted_states(spark):
    rows = versions(150)
    work = new_work_dir(spark, "compact")
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY",))
    keys = sc.cell_keys(spec)
    for part in (rows[:50], rows[50:100], rows[100:]):
        el.flatten(frame(spark, part), LAYOUT).write.mode("append").parquet(f"{work}/in")
        schema = spark.read.parquet(f"{work}/in").schema
        cells = sc.running_cells(stream_files(spark, f"{work}/in", schema), LAYOUT, spec, "fixed(2)")
        sc.run_updates(cells, f"{work}/feed", f"{work}/cp").awaitTermination()
        expected = tuples(sc.snapshot(spark.read.parquet(f"{work}/feed"), keys))
        assert tuples(sc.current_state(spark, f"{work}/feed", f"{work}/states", keys)) == expected
        last = sc.compact(spark, f"{work}/feed", f"{work}/states", keys)
        assert sc.compact(spark, f"{work}/feed", f"{work}/states", keys) == last
        assert tuples(sc.current_state(spark, f"{work}/feed", f"{work}/states", keys)) == expected


def test_rates():
    assert [sc.rate_interval(r) for r in range(6)] == [
        None, "600 milliseconds", "450 milliseconds", "300 milliseconds", "150 milliseconds", "150 milliseconds"
    ]
    with pytest.raises(ValueError):
        sc.rate_interval(6)


def test_pause_starts_nothing(spark):
    assert sc.run_updates(spark.range(1), "nowhere", "nowhere", rate=0) is None


def test_a_rate_paces_the_feed(spark):
    log, path = run(spark, [versions(30)])
    spec = ViewSpec("v", rows=("CCY",))
    work = new_work_dir(spark, "paced")
    cells = sc.running_cells(stream_files(spark, path, log.schema, max_files=1), LAYOUT, spec)
    query = sc.run_updates(cells, f"{work}/feed", f"{work}/cp", rate=5)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    live = sc.snapshot(spark.read.parquet(f"{work}/feed"), sc.cell_keys(spec))
    assert tuples(live, "CCY", "value") == tuples(log.groupBy("CCY").agg(F.sum("value").alias("value")), "CCY", "value")


def test_flat_versions_keep_all_points(spark):
    layout = Layout(core=("CCY",), perimeter=("METRIC",))
    schema = "invariant_key long, seq long, CCY string, METRIC string, value double"
    work = new_work_dir(spark, "flat")
    batches = [
        [(1, 1, "USD", "a", 1.0), (1, 1, "USD", "b", 2.0), (2, 1, "CAD", "a", 5.0)],
        [(1, 1, "USD", "c", 4.0), (2, 2, "CAD", "a", 6.0), (2, 2, "CAD", "b", 7.0)],
        [(1, 2, "USD", "a", 10.0), (2, 1, "CAD", "z", 99.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{work}/in")
        log = upsert.changelog_stream(stream_files(spark, f"{work}/in", spark.createDataFrame([], schema).schema), layout)
        upsert.run_changelog(log, f"{work}/log", f"{work}/cp").awaitTermination()
    log = spark.read.parquet(f"{work}/log")
    assert dict(log.dtypes)["invariant_key"] == "bigint"
    sums = log.groupBy("invariant_key", "METRIC").agg(F.sum("value").alias("v")).filter("v <> 0")
    assert tuples(sums, "invariant_key", "METRIC", "v") == [(1, "a", 10.0), (2, "a", 6.0), (2, "b", 7.0)]


def test_the_newest_rows_of_a_key_may_have_nulls_in_their_order(spark):
    rows = spark.createDataFrame([("k", 1, None, 1.0), ("k", 1, None, 2.0), ("k", 0, 5, 3.0)], "invariant_key string, a int, b int, value double")
    layout = Layout(seq=("a", "b"))
    assert tuples(st.latest_rows(rows, layout), "value") == [(1.0,), (2.0,)]


def test_compacting_a_feed_without_batches(spark):
    work = new_work_dir(spark, "compact")
    assert sc.compact(spark, f"{work}/feed", f"{work}/states", ["k"]) == -1
    with pytest.raises(ValueError):
        sc.current_state(spark, f"{work}/feed", f"{work}/states", ["k"])
    for number in (0, 1):
        spark.createDataFrame([("a", float(number))], "k string, value double").write.parquet(f"{work}/feed/batch={number}")
        for _ in range(2):
            assert sc.compact(spark, f"{work}/feed", f"{work}/states", ["k"]) == number
    assert tuples(sc.current_state(spark, f"{work}/feed", f"{work}/states", ["k"])) == [("a", 1.0)]


def test_a_change_log_takes_no_transform(spark):
    log = spark.createDataFrame([], "CCY string, METRIC string, TENOR string, value double")
    with pytest.raises(ValueError):
        sc.running_cells(log, LAYOUT, ViewSpec("v", rows=("CCY",), transform="against baseline"))


FLAT = Layout(core=("CCY",), perimeter=("METRIC",))


def flat_log(spark, batches, extra=""):
    work = new_work_dir(spark, "flat")
    schema = f"invariant_key string, seq long, CCY string, METRIC string, value double{extra}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{work}/in")
        log = upsert.changelog_stream(stream_files(spark, f"{work}/in", schema), FLAT, buckets=4)
        upsert.run_changelog(log, f"{work}/log", f"{work}/cp").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{work}/log").groupBy("invariant_key", "seq", "CCY", "METRIC").agg(F.sum("value").alias("value")).filter("value <> 0")


def test_flat_rows_without_key_or_order_stay(spark):
    rows = [(None, 1, "USD", "m", 1.0), (None, 2, "USD", "m", 2.0), ("a", None, "USD", "m", 3.0), ("b", None, None, None, 4.0), ("b", 0, "CAD", "n", 5.0)]
    assert tuples(flat_log(spark, [rows[:3], rows[3:]])) == [(None, 2, "USD", "m", 2.0), ("a", None, "USD", "m", 3.0), ("b", 0, "CAD", "n", 5.0)]


def test_rows_sent_again_add_nothing(spark):
    first = [("a", 1, "USD", "m", 1.0), ("a", 1, "USD", "m", 1.0), ("a", 1, "USD", "n", 2.0)]
    assert tuples(flat_log(spark, [first, [*first, ("a", 1, "USD", "o", 7.0)], first[:1]])) == [
        ("a", 1, "USD", "m", 2.0), ("a", 1, "USD", "n", 2.0), ("a", 1, "USD", "o", 7.0)]


def test_points_are_told_apart_by_position(spark):
    one, two = ("a", 1, "USD", "m", 1.0, 0), ("a", 1, "USD", "m", 1.0, 1)
    assert tuples(flat_log(spark, [[one], [two, one], [two, two]], ", pos int")) == [("a", 1, "USD", "m", 2.0)]
