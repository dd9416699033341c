import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.model import Layout
from tallygrid.operators import difference as diff
from tallygrid.operators import elements as el
from tallygrid.operators import store as st
from tallygrid.operators.ordering import numbered, ordered_chunks, with_index, with_neighbour

LAYOUT = Layout(core=("CCY",), perimeter=("METRIC", "TENOR"))
POINTS = "points array<struct<METRIC: string, TENOR: string, value: double>>"
SCHEMA = f"invariant_key string, seq long, CCY string, {POINTS}"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_flatten_skips_empty_elements_and_keeps_missing_labels(spark):
    df = frame(spark, [("a", 1, "USD", [("m", None, 1.0)]), ("b", 1, None, []), ("c", 1, None, None)])
    assert tuples(el.flatten(df, LAYOUT)) == [("a", 1, "USD", 0, "m", None, 1.0)]


def test_deduplicated_keeps_the_last_in_place(spark):
    random.seed(3)
    rows = []
    for k in range(40):
        points = [(random.choice(["a", "b", None]), random.choice(["x", None]), float(i)) for i in range(random.randrange(12))]
        rows.append((str(k), 1, "USD", points))
    found = {r["invariant_key"]: [tuple(p) for p in r["points"]] for r in el.deduplicated(frame(spark, rows), LAYOUT).collect()}
    for key, _, _, points in rows:
        expected = [p for i, p in enumerate(points) if p[:2] not in [q[:2] for q in points[i + 1:]]]
        assert found[key] == expected
    flat = el.deduplicated_rows(el.flatten(frame(spark, rows), LAYOUT), LAYOUT, ["pos"])
    assert tuples(flat, "invariant_key", "METRIC", "TENOR", "value") == tuples(
        el.flatten(el.deduplicated(frame(spark, rows), LAYOUT), LAYOUT), "invariant_key", "METRIC", "TENOR", "value"
    )


def test_resized(spark):
    df = frame(spark, [("a", 1, "USD", [("m", "x", 1.0), ("n", "y", 2.0)])])
    assert [tuple(p) for p in el.resized(df, LAYOUT, 1).first()["points"]] == [("m", "x", 1.0)]
    assert [tuple(p) for p in el.resized(df, LAYOUT, 3).first()["points"]] == [
        ("m", "x", 1.0), ("n", "y", 2.0), (None, None, 0.0)
    ]


def test_filtered_copy_sets_the_tested_label(spark):
    df = frame(spark, [("a", 1, "USD", [("m", "x", 1.0), ("n", "y", 2.0)])])
    found = el.filtered_copy(df, LAYOUT, "TENOR", "y", "XL", F.concat("invariant_key", F.lit("-age")))
    assert tuples(found, "invariant_key", "CCY", "METRIC", "TENOR", "value") == [("a-age", "USD", "n", "XL", 2.0)]
    assert el.filtered_copy(df, LAYOUT, "TENOR", "none", "XL", F.lit("k")).count() == 0


def test_copies(spark):
    df = frame(spark, [("a", 1, "USD", [("m", "x", 1.0)])])
    copied = el.copied(df, LAYOUT, key=F.lit("b"), core={"CCY": F.lit("CAD")}, seq={"seq": F.lit(9)})
    assert copied.first()[:3] == ("b", 9, "CAD")
    assert el.negated(copied, LAYOUT).first()["points"][0]["value"] == -1.0
    with pytest.raises(ValueError):
        el.copied(df, LAYOUT, core={"METRIC": F.lit("z")})


def test_index_of_compares_all_labels(spark):
    df = frame(spark, [("a", 1, "USD", [("m", "x", 1.0), ("m", None, 2.0), ("n", "x", 3.0)])])
    row = df.select(
        el.index_of(LAYOUT, F.col("points"), el.point(LAYOUT, {"METRIC": "m"}, F.lit(0.0)), ["METRIC", "TENOR"]).alias("b"),
        el.index_of(LAYOUT, F.col("points"), el.point(LAYOUT, {"METRIC": "n"}, F.lit(0.0)), ["METRIC"]).alias("c"),
        el.index_of(LAYOUT, F.col("points"), el.point(LAYOUT, {"METRIC": "z"}, F.lit(0.0)), ["METRIC"]).alias("d"),
    ).first()
    assert tuple(row) == (1, 2, -1)


def test_catalog_and_positions(spark):
    df = frame(spark, [("a", 1, "USD", [("m", None, 1.0)])])
    assert tuples(el.attribute_catalog(df, LAYOUT)) == [
        ("CCY", 0, True, 1), ("METRIC", 1, False, 1), ("TENOR", 2, False, 0)
    ]
    assert LAYOUT.position("nope") == -1 and LAYOUT.is_core("nope") and not LAYOUT.is_core("TENOR")
    prints = spark.range(1).select(LAYOUT.fingerprint(), LAYOUT.with_(core=("BOOK",)).fingerprint()).first()
    assert prints[0] != prints[1]


VERSIONS = Layout(core=("label",))


def versions(spark, count=400, hot=0.4):
    """Random versions; one key holds a large part of them, some versions delete."""
    random.seed(11)
    rows = []
    for i in range(count):
        key = "hot" if random.random() < hot else f"k{random.randrange(30)}"
        points = [] if random.random() < 0.1 else [("m", random.choice("xyz"), random.randrange(100) / 4)]
        rows.append((key, i, random.choice(["USD", "CAD"]), points))
    random.shuffle(rows)
    return frame(spark, rows)


def sums(df):
    return {tuple(r)[:-1]: r["s"] for r in df.groupBy("CCY", "METRIC", "TENOR").agg(F.sum("value").alias("s")).collect()}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_changelog_sums_to_the_newest(spark, width):
    df = versions(spark)
    log = st.changelog(df, LAYOUT, F.floor(F.col("seq") / width))
    newest = sums(el.flatten(st.latest(df, LAYOUT), LAYOUT))
    found = sums(log)
    assert {k: v for k, v in found.items() if v != 0} == {k: v for k, v in newest.items() if v != 0}
    assert found == sums(st.ever_seen(df, LAYOUT))
    steps = log.filter("sign < 0").select("invariant_key", "seq", "applied_seq").distinct().collect()
    order = {}
    for r in df.orderBy("seq").collect():
        order.setdefault(r["invariant_key"], []).append(r["seq"])
    for r in steps:
        line = order[r["invariant_key"]]
        assert line[line.index(r["seq"]) + 1] == r["applied_seq"]


def test_an_empty_version_deletes(spark):
    df = frame(spark, [("a", 1, "USD", [("m", "x", 1.0)]), ("a", 2, "USD", [])])
    assert el.flatten(st.latest(df, LAYOUT), LAYOUT).count() == 0
    assert tuples(st.changelog(df, LAYOUT, F.col("seq")), "value", "applied_seq") == [(-1.0, 2), (1.0, 1)]
    assert st.counts(df, LAYOUT).first().asDict() == {"versions": 2, "elements": 1, "points": 0}


def test_latest_rows_equals_latest(spark):
    df = versions(spark)
    flat = el.flatten(df, LAYOUT)
    newest_flat = st.latest_rows(flat, LAYOUT)
    with_points = df.filter(F.size("points") > 0)
    assert tuples(newest_flat) == tuples(el.flatten(st.latest(with_points, LAYOUT), LAYOUT))


def test_lookup(spark):
    df = versions(spark)
    one = st.lookup(df, LAYOUT, ["hot", "none"])
    many = st.lookup(df, LAYOUT, spark.createDataFrame([("hot",), ("none",), ("hot",)], "k string"))
    assert tuples(one) == tuples(many) and {r["invariant_key"] for r in one.collect()} <= {"hot"}


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_neighbours_and_numbers_in_chunks(spark, width):
    random.seed(5)
    data = [("g" if random.random() < 0.5 else f"g{i % 9}", i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, at long")
    chunk = F.floor(F.col("at") / width)
    groups = {}
    for g, at in data:
        groups.setdefault(g, []).append(at)
    after = {(r["g"], r["at"]): r["n"] for r in with_neighbour(df, ["g"], ["at"], chunk, "n").collect()}
    before = {(r["g"], r["at"]): r["n"] for r in with_neighbour(df, ["g"], ["at"], chunk, "n", following=False).collect()}
    place = {(r["g"], r["at"]): r["n"] for r in numbered(df, ["g"], ["at"], chunk, "n").collect()}
    for g, line in groups.items():
        for i, at in enumerate(line):
            assert after[g, at] == (line[i + 1] if i + 1 < len(line) else None)
            assert before[g, at] == (line[i - 1] if i else None)
            assert place[g, at] == i


def test_ordered_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n"), F.lit(0).alias("all"))
    found = with_index(ordered_chunks(df, ["n"], chunk_rows=16), ["all"], "place")
    assert all(r["n"] == r["place"] for r in found.collect())
    assert found.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 16


def test_subtract_positional(spark):
    left = frame(spark, [("a", 2, "USD", [("m", "x", 5.0), ("n", None, 7.0)]), ("b", 2, "USD", [("m", "x", 1.0)])])
    right = frame(spark, [("a", 1, "CAD", [("p", "q", 2.0), ("r", None, 3.0)]), ("b", 1, "USD", [])])
    found = el.flatten(diff.subtract_positional(left, right, LAYOUT), LAYOUT)
    assert tuples(found, "invariant_key", "METRIC", "TENOR", "value") == [
        ("a", "m", "x", 3.0), ("a", "n", None, 4.0), ("b", "m", "x", 1.0)
    ]


def test_subtract_by_labels(spark):
    left = frame(spark, [("a", 2, "USD", [("m", None, 5.0), ("n", "y", 7.0)])])
    right = frame(spark, [("a", 1, "USD", [("m", None, 2.0), ("z", "y", 3.0)])])
    assert tuples(diff.subtract_by_labels(left, right, LAYOUT), "METRIC", "TENOR", "value") == [
        ("m", None, 3.0), ("n", "y", 7.0), ("z", "y", -3.0)
    ]


def test_against_baseline(spark):
    newest = frame(spark, [
        ("a", 2, "USD", [("m", "x", 5.0)]), ("a-SOD", 1, "USD", [("m", "x", 2.0)]),
        ("b", 2, "USD", [("m", "x", 1.0)]), ("c-SOD", 2, "USD", [("m", "x", 9.0)]),
    ])
    assert tuples(diff.against_baseline(newest, LAYOUT), "invariant_key", "value") == [
        ("a", 3.0), ("a-SOD", 2.0), ("b", 1.0), ("c-SOD", 9.0)
    ]
    assert ("a", 1.0) in tuples(diff.against_baseline(newest, LAYOUT, factor=2.0), "invariant_key", "value")


def test_a_hot_key_within_one_moment_is_cut_by_the_data(spark, monkeypatch):
    """A third of all rows share a key and a day: without a chunk expression, no chunk holds more than its share."""
    from tallygrid.operators import ordering

    rows = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at int")
    chunks = ordering.ordered_chunks(df, ["g", "at"], 100)
    assert max(r["count"] for r in chunks.filter("g = 'hot'").groupBy("_chunk").count().collect()) <= 100
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 100)
    found = {(r["g"], r["at"]): r["n"] for r in with_neighbour(df, ["g"], ["at"], None, "n").collect()}
    hot = [i for i in range(3000) if i % 3 == 0]
    assert all(found["hot", a] == b for a, b in zip(hot, [*hot[1:], None]))
    assert sum(v is not None for v in found.values()) == len(hot) - 1
    places = {(r["g"], r["at"]): r["n"] for r in numbered(df, ["g"], ["at"], None, "n").collect()}
    assert all(places["hot", a] == n for n, a in enumerate(hot))


def test_attribute_names_need_no_data(spark):
    empty = spark.createDataFrame([], "invariant_key string, seq long")
    found = el.attribute_catalog(empty, Layout(core=("A",), perimeter=("B",)), counted=False).collect()
    assert [tuple(r) for r in found] == [("A", 0, True, None), ("B", 1, False, None)]


def test_a_version_without_order_is_the_earliest(spark):
    rows = [("a", None, "USD", [("m", None, 5.0)]), ("b", None, "CAD", []), ("b", 1, "USD", [("m", "x", 2.0)])]
    found = st.latest(frame(spark, rows), LAYOUT)
    assert tuples(found, "invariant_key", "seq", "CCY") == [("a", None, "USD"), ("b", 1, "USD")]
    assert tuple(st.counts(frame(spark, rows), LAYOUT).first()) == (3, 2, 2)
