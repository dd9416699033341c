import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.functions import display as d
from tallygrid.operators import changes as ch
from tallygrid.operators import grid as g
from tallygrid.model import Layout
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import view_cells


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "number, text",
    [(1234567.4, "1,234,567"), (-1234.5, "(1,234)"), (0.5, "0"), (1.5, "2"), (2.5, "2"), (-0.4, "(0)"), (0.0, "0"), (-999.6, "(1,000)")],
)
def test_accounting(spark, number, text):
    assert one(spark, d.accounting(F.lit(number))) == text
    assert one(spark, d.parse_accounting(F.lit(text))) == float(text.replace(",", "").replace("(", "-").replace(")", ""))


def test_parse_accounting_without_number(spark):
    assert one(spark, d.parse_accounting(F.lit("abc"))) is None


@pytest.mark.parametrize("number, text", [(2.5, "3"), (-2.5, "-2"), (1234.49, "1,234")])
def test_rounded(spark, number, text):
    assert one(spark, d.rounded(F.lit(number))) == text


@pytest.mark.parametrize(
    "tenor, days",
    [("3Y", 1095), ("2W", 14), ("5D", 5), ("6M", 186), ("1B", 1), ("2024-01-11", 10), ("20231222", -10), ("Feb-24", 45),
     ("DEC-23", -17), ("O/N", 0), ("", 0), ("xY", 0), ("Foo-24", 0)],
)
def test_tenor_days(spark, tenor, days):
    assert one(spark, d.tenor_days(F.lit(tenor), dt.date(2024, 1, 1))) == days


def test_tenor_text(spark):
    assert one(spark, d.tenor_text(F.lit(31))) == "0000031"
    assert one(spark, d.tenor_text(F.lit(-2900))) == "00-2900"
    assert one(spark, d.tenor_text(F.lit(123456789))) == "3456789"


def test_rank_text(spark):
    order = d.RANKS["CCY"]
    assert [one(spark, d.rank_text(F.lit(x), order)) for x in ("USD", "JPY", "SEK", "Total")] == ["1", "5", "SEK", " "]


SPEC = ViewSpec("grid", rows=("TENOR",), cols=("CCY",))


def test_sort_needs_a_date(spark):
    with pytest.raises(ValueError):
        d.sort_key(F.lit("1Y"), F.lit(False), "TENOR")


def test_grid_order(spark):
    cells = spark.createDataFrame(
        [(c, t, 1.0) for c in ("JPY", "AUD", "USD", "Total") for t in ("1Y", "2W", "Total", "1M")],
        "CCY string, TENOR string, value double",
    )
    rows = g.grid_order(cells, SPEC, as_of="2024-01-01", tenors=("TENOR",))
    assert [r["TENOR"] for r in rows.orderBy("position").collect()] == ["Total", "2W", "1M", "1Y"]
    cols = g.grid_order(cells, SPEC, rows=False)
    assert [r["CCY"] for r in cols.orderBy("position").collect()] == ["Total", "USD", "JPY", "AUD"]


def walk_rows(rows, closed):
    """The rule for rows, one row at a time."""
    hidden, hide = [], False
    for labels in rows:
        hidden.append(hide)
        if labels in closed:
            hide = True
        elif "\t".join(labels).find("Total") > 0:
            hide = False
    return hidden


def walk_columns(columns, closed):
    """The rule for columns, one column at a time."""
    hidden, block = [], None
    for labels in columns:
        if block is not None and labels[block] != "Total":
            hidden.append(True)
            continue
        block = max(i for i, x in enumerate(labels) if x == "Total") if labels in closed else None
        hidden.append(False)
    return hidden


def random_labels(depth, seed):
    rng = random.Random(seed)
    found = {tuple(rng.choice(["Total", "a", "b", "c"]) for _ in range(depth)) for _ in range(25)}
    ordered = sorted(found, key=lambda t: [(x != "Total", x) for x in t])
    opened = [t for t in ordered if "Total" in t and rng.random() < 0.5]
    return ordered, opened, {t for t in ordered if "Total" in t and t not in opened}


@pytest.mark.parametrize("depth, seed, chunk_rows", [(1, 1, 2), (2, 2, 3), (3, 3, 2), (3, 4, 4096), (3, 5, 5)])
def test_visibility_follows_the_rules(spark, depth, seed, chunk_rows):
    ordered, opened, closed = random_labels(depth, seed)
    names = [f"L{i}" for i in range(depth)]
    schema = ", ".join(f"{n} string" for n in names)
    labels = spark.createDataFrame(ordered, schema).withColumn("value", F.lit(1.0))
    expanded = spark.createDataFrame(opened, schema)
    rows = g.row_visibility(labels, ViewSpec("v", rows=tuple(names)), expanded, chunk_rows)
    assert {tuple(r)[:-1]: r["hidden_row"] for r in rows.collect()} == dict(zip(ordered, walk_rows(ordered, closed)))
    cols = g.column_visibility(labels, ViewSpec("v", cols=tuple(names)), expanded, chunk_rows)
    assert {tuple(r)[:-1]: r["hidden_col"] for r in cols.collect()} == dict(zip(ordered, walk_columns(ordered, closed)))


def test_everything_is_closed_by_default(spark):
    cells = spark.createDataFrame(
        [("USD", t, 1.0) for t in ("Total", "1Y", "2Y")], "CCY string, TENOR string, value double"
    ).unionByName(spark.createDataFrame([("Total", "Total", 1.0)], "CCY string, TENOR string, value double"))
    spec = ViewSpec("v", rows=("CCY", "TENOR"))
    rows = g.row_visibility(cells, spec)
    assert tuples(rows) == [("Total", "Total", False), ("USD", "1Y", True), ("USD", "2Y", True), ("USD", "Total", True)]


CELLS = [("USD", "1Y", 1.0), ("USD", "2Y", None), ("CAD", "1Y", None), ("CAD", "2Y", None), ("JPY", "2Y", None), ("JPY", "3Y", 4.0)]


def test_wide_and_empty(spark):
    cells = spark.createDataFrame(CELLS, "CCY string, TENOR string, value double")
    grid = g.wide(cells, SPEC)
    assert grid.columns == ["TENOR", "CAD", "JPY", "USD"]
    assert tuples(g.without_empty(grid, ["TENOR"])) == [("1Y", None, 1.0), ("3Y", 4.0, None)]
    assert g.without_empty(grid, ["TENOR"]).columns == ["TENOR", "JPY", "USD"]


def test_too_many_columns_is_an_error(spark):
    cells = spark.range(20).select(F.col("id").cast("string").alias("CCY"), F.lit("1Y").alias("TENOR"), F.lit(1.0).alias("value"))
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        with pytest.raises(ValueError):
            g.wide(cells, SPEC)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_selection_total(spark):
    shown = spark.createDataFrame([("a", "1,000"), ("b", "(2)"), ("c", "5")], "k string, shown string")
    picked = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert g.selection_total(shown, picked, ["k"]).first()["total"] == 998.0


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "CCY string, TENOR string, value double, is_total boolean, hidden boolean")


def test_cell_changes(spark):
    before = cells_of(spark, [
        ("USD", "1Y", 1.0, False, False), ("USD", "2Y", 2.0, False, False), ("CAD", "1Y", 3.0, False, False),
        ("Total", "1Y", 5.0, True, False), ("Total", "3Y", 5.0, True, False),
    ])
    after = cells_of(spark, [
        ("USD", "1Y", 1.0, False, False), ("USD", "2Y", 2.5, False, False), ("USD", "3Y", 0.0, False, False),
        ("Total", "1Y", 5.0 + 1e-9, True, False), ("Total", "2Y", 0.0, True, False), ("Total", "3Y", 6.0, True, False),
    ])
    keys = ["CCY", "TENOR"]
    assert tuples(ch.cell_changes(before, after, keys), "CCY", "TENOR", "command", "value") == [
        ("CAD", "1Y", "DEL", None), ("Total", "3Y", "UPD", 6.0), ("USD", "2Y", "UPD", 2.5), ("USD", "3Y", "UPD", 0.0)
    ]
    touched = spark.createDataFrame([("USD", "1Y")], "CCY string, TENOR string")
    assert ("USD", "1Y") in tuples(ch.cell_changes(before, after, keys, touched), "CCY", "TENOR")
    assert tuples(ch.vanished(before, after, keys)) == [("CAD", "1Y")]
    gone = ch.vanished_axis_records(before, after, SPEC, rows=False)
    assert tuples(gone) == [("grid", "DELC", ["CAD"])]
    assert ch.vanished_axis_records(before, after, SPEC, rows=True).count() == 0


def test_records_are_valid_json(spark):
    cells = cells_of(spark, [('U"SD', "1Y", -1234.5, False, False), ("USD", "1Y", 1.0, False, True)])
    lines = [r["value"] for r in ch.as_json(ch.update_records(cells, SPEC)).collect()]
    assert lines == ['{"viewName":"grid","command":"UPD","rowKeys":["1Y"],"colKeys":["U\\"SD"],"value":"(1,234)"}']


def test_hidden_cells_stay_out_of_changes(spark):
    before = cells_of(spark, [("USD", "1Y", 1.0, False, True), ("USD", "Total", 1.0, True, False)])
    after = cells_of(spark, [("USD", "1Y", 2.0, False, True), ("CAD", "1Y", 9.0, False, True), ("USD", "Total", 11.0, True, False)])
    keys = ["CCY", "TENOR"]
    assert tuples(ch.cell_changes(before, after, keys), "CCY", "TENOR", "command", "value") == [("USD", "Total", "UPD", 11.0)]


def test_a_total_wins_over_a_label_that_reads_total(spark):
    cells = cells_of(spark, [("USD", "Total", 4.0, False, False), ("USD", "Total", 7.0, True, False), ("USD", "1Y", 3.0, False, False)])
    assert tuples(g.wide(cells, SPEC), "TENOR", "USD") == [("1Y", 3.0), ("Total", 7.0)]
    records = ch.update_records(cells, SPEC)
    assert sorted((r["rowKeys"][0], r["value"]) for r in records.collect()) == [("1Y", "3"), ("Total", "7")]
    grown = cells_of(spark, [("USD", "Total", 5.0, False, False), ("USD", "Total", 7.0, True, False), ("USD", "1Y", 3.0, False, False)])
    assert ch.cell_changes(cells, grown, ["CCY", "TENOR"]).count() == 0


def test_the_widest_of_totals_that_read_the_same_counts(spark):
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY",), totals=("TENOR", "CCY"))
    layout = Layout(core=("CCY", "TENOR"))
    rows = [("Total", "Total", 4.0), ("USD", "m", 3.0), ("Total", "m", -9.0)]
    for order in (rows, rows[::-1]):
        cells = view_cells(spark.createDataFrame(order, "CCY string, TENOR string, value double").coalesce(1), layout, spec, levels=True)
        assert tuples(ch.published(cells, spec.columns).filter("CCY = 'Total' AND TENOR = 'Total'"), "value", "is_total") == [(-2.0, True)]
        changes = ch.cell_changes(cells.limit(0), cells, spec.columns)
        assert tuples(changes.filter("CCY = 'Total' AND TENOR = 'Total'"), "command", "value") == [("UPD", -2.0)]
        assert tuples(g.wide(cells, spec).filter("TENOR = 'Total'"), "Total") == [(-2.0,)]


def test_start_states_in_blocks_equal_a_walk(spark):
    import random

    rng = random.Random(3)
    ends = [(c, [rng.randrange(-1, 3) for _ in range(4)]) for c in sorted(rng.sample(range(5000), 60))]
    state, wanted = -1, []
    for chunk, after in ends:
        wanted.append((chunk, state))
        state = after[state + 1]
    for block in (3, 100, 10_000):
        found = g.start_states(spark.createDataFrame(ends, "_chunk bigint, _ends array<int>").repartition(3), block)
        assert sorted((r._chunk, r._start) for r in found.collect()) == wanted


def test_pages_of_many_columns(spark):
    spec = ViewSpec("v", rows=("K",), cols=("C",))
    cells = spark.range(50_000).select(F.format_string("c%06d", "id").alias("C"), F.concat(F.lit("k"), F.col("id") % 3).alias("K"), F.col("id").cast("double").alias("value"))
    headers, grid = g.pages(cells, spec, 500)
    assert (headers.count(), headers.agg(F.max("page")).first()[0], len(grid.columns)) == (50_000, 99, 502)
    assert grid.count() == 300
    assert tuples(headers.filter("C = 'c012345'"), "page", "place") == [(24, 345)]
    assert tuples(grid.filter("page = 24 AND K = 'k0'"), "c345") == [(12345.0,)]
