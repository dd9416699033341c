import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.model import Layout
from tallygrid.operators import store as st
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import all_views, register_transform
from tallygrid.session import new_work_dir
from tallygrid.sources.feeds import stream_files
from tallygrid.streaming import live

LAYOUT = Layout(core=("CCY",), perimeter=("METRIC",))
SCHEMA = "invariant_key string, seq long, CCY string, epoch long, mark string, points array<struct<METRIC: string, value: double>>"

VIEWS = (
    ViewSpec("by currency", rows=("METRIC",), cols=("CCY",), totals=("METRIC", "CCY")),
    ViewSpec("metrics", rows=("METRIC",), filters={"CCY": ("USD", "-")}, renames={"METRIC": {"m": "M"}}),
    ViewSpec("hidden", rows=("METRIC",), cols=("CCY",), totals=("CCY",), hide=("METRIC",)),
)


def elements(count, seed=1, keys=12, suffixes=("",)):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        points = [] if rng.random() < 0.15 else [(rng.choice(["m", "n", None]), rng.randrange(400) / 4) for _ in range(rng.randrange(1, 4))]
        key = "hot" if rng.random() < 0.3 else f"k{rng.randrange(keys)}"
        rows.append((key + rng.choice(suffixes), i, rng.choice(["USD", "CAD", None]), 0, None, points))
    return rows


class Run:
    """A feed that is stopped and started again for every batch of elements."""

    def __init__(self, spark, views, **options):
        self.spark, self.views, self.options = spark, views, options
        self.work = new_work_dir(spark, "live")
        self.feed = live.Feed(spark, f"{self.work}/feed")

    def stream(self):
        source = stream_files(self.spark, f"{self.work}/in", SCHEMA)
        return live.live_records(source, LAYOUT, self.views, fills=self.feed.fills(self.options.get("measure", "double")), buckets=4, **self.options)

    def give(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.work}/in")
        query = self.feed.start(self.stream(), partitions=2)
        query.awaitTermination()
        return query


def cells(df, *more):
    return tuples(df.filter("value <> 0"), "view", "col_keys", "row_keys", "is_total", "value")


def batch_cells(spark, rows, views):
    newest = st.latest(spark.createDataFrame(rows, SCHEMA), LAYOUT)
    return cells(all_views(newest, LAYOUT, views).filter("NOT hidden"))


def test_feed_equals_batch_after_every_micro_batch(spark):
    rows, run = elements(160), Run(spark, VIEWS)
    for a, b in ((0, 60), (60, 61), (61, 160)):
        query = run.give(random.Random(a).sample(rows[a:b], b - a))
        assert len(query.lastProgress.stateOperators) == 2  # versions, and the sums of all views
        attached, position = run.feed.attach()
        assert cells(attached) == batch_cells(spark, rows[:b], VIEWS)
    assert position == 2


def test_records_tell_what_changed(spark):
    view = ViewSpec("v", rows=("METRIC",), totals=("METRIC",))
    run = Run(spark, (view,), measure="fixed(2)")
    run.give([("a", 1, "USD", 0, None, [("m", 1.25), ("n", 2.0)]), ("b", 1, "USD", 0, None, [("m", 1.0)])])
    run.give([("a", 2, "USD", 0, None, [("m", 1.0), ("n", 2.25)])])
    run.give([("a", 1, "USD", 0, None, [("m", 50.0)])])
    shown = ["batch", "command", "row_keys", "is_total", "before", "value"]
    assert tuples(run.feed.records(), *shown) == sorted([
        (0, "UPD", ["Total"], True, None, 4.25), (0, "UPD", ["m"], False, None, 2.25), (0, "UPD", ["n"], False, None, 2.0),
        (1, "UPD", ["m"], False, 2.25, 2.0), (1, "UPD", ["n"], False, 2.0, 2.25),
    ], key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_a_total_beats_a_stored_label_and_the_wider_total_wins(spark):
    view = ViewSpec("v", rows=("METRIC",), cols=("CCY",), totals=("METRIC", "CCY"))
    run = Run(spark, (view,))
    run.give([("a", 1, "Total", 0, None, [("Total", 4.0)]), ("b", 1, "USD", 0, None, [("m", 3.0)])])
    found, _ = run.feed.attach()
    assert {(r.col_keys[0], r.row_keys[0]): (r.value, r.is_total) for r in found.collect()}["Total", "Total"] == (7.0, True)


def test_cost_does_not_grow_with_age(spark):
    run = Run(spark, VIEWS[:1])
    inputs = []
    for i in range(50):
        spark.createDataFrame([(f"k{i % 5}", i, "USD", 0, None, [("m", 1.0)])], SCHEMA).coalesce(1).write.mode("append").parquet(f"{run.work}/in")
    source = stream_files(spark, f"{run.work}/in", SCHEMA, max_files=1)
    query = run.feed.start(live.live_records(source, LAYOUT, VIEWS[:1], buckets=2), partitions=1)
    query.awaitTermination()
    inputs = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert inputs == [1] * 50
    assert {p.stateOperators[0].numRowsTotal for p in query.recentProgress[10:]} == {query.lastProgress.stateOperators[0].numRowsTotal}
    assert run.feed.position() == 49


BASED = ViewSpec("moves", rows=("METRIC",), cols=("CCY",), totals=("CCY",), transform="against baseline", transform_arg="2.0")


def test_baseline_follows_both_sides(spark):
    views = (BASED, VIEWS[0])
    rows, run = elements(140, seed=4, keys=3, suffixes=("", "-SOD", "-SOD-SOD")), Run(spark, (BASED, VIEWS[0]))
    for a, b in ((0, 30), (30, 31), (31, 140)):
        run.give(rows[a:b])
        assert cells(run.feed.attach()[0]) == batch_cells(spark, rows[:b], views)


def _only_dollars(df, layout):
    return df.filter("CCY = 'USD'")


def _times(df, layout, factor="1"):
    return df.withColumn(layout.points, F.transform(layout.points, lambda p: p.withField(layout.value, p[layout.value] * float(factor))))


register_transform("test dollars", _only_dollars)
register_transform("test times", _times)


def test_transforms_drop_and_change_elements(spark):
    views = (
        ViewSpec("dollars", rows=("METRIC",), transform="test dollars"), ViewSpec("tripled", rows=("CCY",), totals=("CCY",), transform="test times", transform_arg="3"),
        VIEWS[0], BASED,
    )
    rows, run = elements(120, seed=6, suffixes=("", "-SOD")), Run(spark, views)
    newest = {}
    for a, b in ((0, 50), (50, 120)):
        run.give(rows[a:b])
        for r in rows[a:b]:
            newest[r[0]] = r
        assert cells(run.feed.attach()[0]) == batch_cells(spark, rows[:b], views)


def test_a_transform_that_loses_columns_is_refused(spark):
    register_transform("test narrow", lambda df, layout: df.select("invariant_key", "seq", "CCY", "points"))
    run = Run(spark, (ViewSpec("v", rows=("CCY",), transform="test narrow"),))
    with pytest.raises(ValueError):
        run.give(elements(2))


def marker(epoch, kind):
    return (None, None, None, epoch, kind, None)


def test_an_epoch_is_published_once_when_it_closes(spark):
    view = ViewSpec("v", rows=("METRIC",))
    run = Run(spark, (view,), epoch="epoch", marker="mark")

    def element(key, seq, epoch, metric, value):
        return (key, seq, "USD", epoch, None, [(metric, value)])

    def told(batch):
        return tuples(run.feed.records(batch - 1, batch), "command", "row_keys", "before", "value")

    run.give([marker(1, "open"), element("a", 1, 1, "m", 1.0), element("b", 1, 1, "n", 2.0)])
    assert told(0) == []
    run.give([element("c", 2, 1, "o", 3.0)])
    assert told(1) == []
    run.give([marker(1, "close")])
    assert told(2) == [("UPD", ["m"], None, 1.0), ("UPD", ["n"], None, 2.0), ("UPD", ["o"], None, 3.0)]
    run.give([element("a", 3, 1, "m", 1.5)])
    assert told(3) == [("UPD", ["m"], 1.0, 1.5)]
    run.give([marker(2, "open"), element("a", 4, 2, "m", 1.5)])
    run.give([element("b", 5, 1, "n", 9.0)])
    assert told(4) == told(5) == []
    run.give([element("d", 6, 2, "p", 4.0), marker(2, "close"), marker(2, "close")])
    assert told(6) == [("DEL", ["n"], 2.0, None), ("DEL", ["o"], 3.0, None), ("UPD", ["p"], None, 4.0)]
    run.give([element("e", 7, 1, "m", 100.0)])
    assert told(7) == []
    assert cells(run.feed.attach()[0]) == [("v", [""], ["m"], False, 1.5), ("v", [""], ["p"], False, 4.0)]


def test_attach_before_and_between_batches(spark):
    rows, run = elements(90, seed=8), Run(spark, VIEWS[:2])
    empty, position = run.feed.attach()
    assert (empty.count(), position, run.feed.compact()) == (0, -1, -1)
    run.give(rows[:30])
    assert run.feed.compact() == 0
    run.give(rows[30:60])
    attached, position = run.feed.attach()
    assert position == 1 and cells(attached) == batch_cells(spark, rows[:60], VIEWS[:2])
    kept = {(r.view, *r.col_keys, *r.row_keys): r.value for r in attached.collect()}
    run.give(rows[60:])
    run.feed.compact()
    assert run.feed.compact() == 2
    query = run.feed.tail(position).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    for r in spark.table("followed").orderBy("batch").collect():
        assert r.batch == 2
        kept[(r.view, *r.col_keys, *r.row_keys)] = r.value
    assert kept == {(r.view, *r.col_keys, *r.row_keys): r.value for r in run.feed.attach()[0].collect()}


def test_a_view_is_added_to_a_feed(spark):
    rows, run = elements(120, seed=9), Run(spark, VIEWS[:1])
    run.give(rows[:50])
    run.give(rows[50:80])
    source = spark.createDataFrame([], SCHEMA)
    new = VIEWS[1]
    assert run.feed.add_view(new, source, LAYOUT, run.views) == 1
    with pytest.raises(ValueError):
        run.feed.add_view(new, source, LAYOUT, run.views)
    run.views = (*run.views, new)
    run.give(rows[80:])
    assert cells(run.feed.attach()[0]) == batch_cells(spark, rows, VIEWS[:2])


def test_adding_a_view_before_the_first_batch_needs_no_filling(spark):
    run = Run(spark, VIEWS[:1])
    assert run.feed.add_view(VIEWS[1], spark.createDataFrame([], SCHEMA), LAYOUT, run.views) == -1


def test_counts_per_micro_batch(spark):
    counters = live.Counters()
    spark.streams.addListener(counters)
    try:
        run = Run(spark, VIEWS[:1])
        rows = elements(40, seed=11)
        for part in (rows[:10], rows[10:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{run.work}/in")
        source = live.counted(stream_files(spark, f"{run.work}/in", SCHEMA, max_files=1), LAYOUT)
        query = run.feed.start(live.live_records(source, LAYOUT, VIEWS[:1], buckets=2))
        query.awaitTermination()
        for _ in range(100):
            if counters.totals["versions"] == 40:
                break
            __import__("time").sleep(0.1)
        own = [c for (_, number), c in sorted(counters.batches.items()) if c["versions"]]
        assert [c["versions"] for c in own] == [10, 30]
        assert counters.totals == {"versions": 40, "points": sum(len(r[5]) for r in rows), "deletions": sum(not r[5] for r in rows)}
        assert own[-1]["state_rows"] > 0
    finally:
        spark.streams.removeListener(counters)


def test_the_rate_of_a_running_feed_changes(spark):
    run = Run(spark, VIEWS[:1])
    run.give(elements(10))
    query = run.feed.change_rate(None, run.stream(), 5)
    spark.createDataFrame(elements(30)[10:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{run.work}/in")
    query.processAllAvailable()
    query = run.feed.change_rate(query, run.stream(), 2)
    assert query.isActive
    assert run.feed.change_rate(query, run.stream(), 0) is None
    assert cells(run.feed.attach()[0]) == batch_cells(spark, elements(30), VIEWS[:1])


def test_two_views_of_one_name_and_other_measures_are_refused(spark):
    run = Run(spark, (VIEWS[0], VIEWS[0]))
    with pytest.raises(ValueError):
        run.give(elements(1))
    run = Run(spark, VIEWS[:1], measure="decimal(18,2)")
    with pytest.raises(ValueError):
        run.give(elements(1))
