import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.functions.labels import cell_key, join_key, one_of, split_key, value_label
from tallygrid.model import Layout
from tallygrid.plans.spec import ViewSpec, total_sets
from tallygrid.plans.view import all_views, register_transform, view_cells

LAYOUT = Layout(core=("CCY", "BOOK"), perimeter=("METRIC", "TENOR"))
SCHEMA = (
    "invariant_key string, seq long, CCY string, BOOK string, "
    "points array<struct<METRIC: string, TENOR: string, value: double>>"
)
ROWS = [
    ("1", 1, "USD", "Alpha", [("IR", "1Y", 1.0), ("NPV", None, 10.0)]),
    ("2", 1, "CAD", "Beta", [("IR", "1Y", 2.0), ("IR", "2Y", 3.0)]),
    ("3", 1, "USD", None, [("NPV", None, 20.0)]),
    ("4", 1, "USD", "Total", [("IR", "2Y", 4.0)]),
    ("5", 1, "USD", "Alpha", []),
]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def shown(spec, rule, base):
    """Total keys of one base cell, written ``cols // rows``."""
    cols = len(spec.col_axes)
    found = []
    for kept in total_sets(spec, rule):
        labels = [x if i in kept else "Total" for i, x in enumerate(base)]
        found.append(f"{','.join(labels[:cols])} // {','.join(labels[cols:])}")
    return sorted(found)


WIDE = ViewSpec("wide", rows=("TENOR",), cols=("CCY", "PRODUCT", "EVENT"), totals=("TENOR", "PRODUCT"))
ACROSS = ViewSpec("across", rows=("CCY",), cols=("BOOK",), totals=("BOOK",))
DOWN = ViewSpec("down", rows=("BOOK",), cols=("CCY",), totals=("BOOK",))
MIDDLE = ViewSpec("middle", rows=("TENOR",), cols=("PRODUCT", "EVENT"), totals=("PRODUCT",))


@pytest.mark.parametrize(
    "spec, base, documented, observed",
    [
        (WIDE, ["USD", "SWAP", "SOD", "1Y"],
         ["USD,SWAP,SOD // Total", "USD,Total,SOD // 1Y", "USD,Total,SOD // Total"],
         ["Total,Total,Total // 1Y", "USD,Total,Total // 1Y", "USD,Total,Total // Total"]),
        (ACROSS, ["BookX", "USD"], ["Total // USD"], ["BookX // Total"]),
        (DOWN, ["USD", "Alpha"], ["USD // Total"], ["Total // Alpha"]),
        (MIDDLE, ["OTC", "SOD", "1Y"], ["Total,SOD // 1Y"], ["OTC,Total // Total"]),
    ],
)
def test_total_keys(spec, base, documented, observed):
    assert shown(spec, "documented", base) == documented
    assert shown(spec, "observed", base) == observed


def test_total_rules_are_guarded():
    two_rows = ViewSpec("v", rows=("A", "B"), totals=("A",))
    with pytest.raises(ValueError):
        total_sets(two_rows, "observed")
    with pytest.raises(ValueError):
        total_sets(two_rows, "other")
    assert total_sets(two_rows, "none") == []
    assert total_sets(ViewSpec("v", rows=("A",), totals=("C",)), "documented") == []


def test_cells_with_totals(elements):
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY",), totals=("TENOR", "CCY"), filters={"METRIC": ("IR",)})
    assert tuples(view_cells(elements, LAYOUT, spec), "CCY", "TENOR", "value", "is_total") == [
        ("CAD", "1Y", 2.0, False), ("CAD", "2Y", 3.0, False), ("CAD", "Total", 5.0, True),
        ("Total", "1Y", 3.0, True), ("Total", "2Y", 7.0, True), ("Total", "Total", 10.0, True),
        ("USD", "1Y", 1.0, False), ("USD", "2Y", 4.0, False), ("USD", "Total", 5.0, True),
    ]


def test_a_label_that_reads_total_stays_a_base_cell(elements):
    spec = ViewSpec("v", rows=("BOOK",), totals=("BOOK",))
    cells = tuples(view_cells(elements, LAYOUT, spec), "BOOK", "value", "is_total")
    assert ("Total", 4.0, False) in cells and ("Total", 40.0, True) in cells


def test_missing_labels(elements):
    spec = ViewSpec("v", rows=("BOOK",), filters={"BOOK": ("-",)}, renames={"BOOK": {"-": "none"}})
    assert tuples(view_cells(elements, LAYOUT, spec), "BOOK", "value") == [("none", 20.0)]


def test_filters_see_labels_before_renaming(elements):
    spec = ViewSpec("v", rows=("CCY",), filters={"CCY": ("CAD",)}, renames={"CCY": {"CAD": "USD"}})
    assert tuples(view_cells(elements, LAYOUT, spec), "CCY", "value") == [("USD", 5.0)]


def test_unknown_attributes(elements):
    constant = ViewSpec("v", rows=("Desk",), cols=())
    assert tuples(view_cells(elements, LAYOUT, constant), "col_label", "Desk", "value") == [("", "Desk", 40.0)]
    nothing = ViewSpec("v", rows=("CCY",), filters={"TYPE": ("P&L",)})
    assert view_cells(elements, LAYOUT, nothing).count() == 0


def test_hidden_views_publish_totals_only(elements):
    spec = ViewSpec("v", rows=("TENOR",), cols=("CCY",), totals=("TENOR",), hide=("TENOR",))
    cells = view_cells(elements, LAYOUT, spec, only_visible=True)
    assert tuples(cells, "CCY", "TENOR", "value") == [("CAD", "Total", 5.0), ("USD", "Total", 35.0)]


def test_one_attribute_on_both_sides(elements):
    spec = ViewSpec("v", rows=("CCY",), cols=("CCY",))
    assert tuples(view_cells(elements, LAYOUT, spec), "CCY", "CCY_", "value") == [
        ("CAD", "CAD", 5.0), ("USD", "USD", 35.0)
    ]


def test_long_renames_equal_short_ones(elements):
    table = {"USD": "X", "CAD": "X"}
    long_table = {**table, **{f"unused {i}": "Y" for i in range(100)}}
    results = [
        tuples(view_cells(elements, LAYOUT, ViewSpec("v", rows=("CCY",), renames={"CCY": t}), "fixed(2)"))
        for t in (table, long_table)
    ]
    assert results[0] == results[1]


@pytest.mark.parametrize("measure", ["double", "fixed(2)", "decimal(18,2)"])
def test_many_views_equal_single_views(elements, measure):
    specs = [
        ViewSpec("a", rows=("TENOR",), cols=("CCY", "BOOK"), totals=("TENOR", "BOOK")),
        ViewSpec("b", rows=("BOOK", "CCY"), filters={"METRIC": ("NPV",)}, hide=("CCY",)),
        ViewSpec("c", cols=("Total", "METRIC"), totals=("METRIC",), renames={"METRIC": {"NPV": "IR"}}),
    ]
    together = all_views(elements, LAYOUT, specs, measure)
    for spec in specs:
        alone = view_cells(elements, LAYOUT, spec, measure)
        cols = F.array(*[a.column for a in spec.col_axes])
        rows = F.array(*[a.column for a in spec.row_axes])
        assert tuples(together.filter(F.col("view") == spec.name).drop("view")) == tuples(
            alone.select(cols.alias("col_keys"), rows.alias("row_keys"), "value", "is_total", "hidden")
        )


def test_fixed_sums_are_exact(spark):
    layout = Layout(core=("A",))
    numbers = [0.1, -0.3, 1e13 + 0.01, -1e13, 0.2, -7.77] * 50
    df = spark.createDataFrame([(str(i), i, "x", n) for i, n in enumerate(numbers)], "invariant_key string, seq long, A string, value double")
    cells = view_cells(df, layout, ViewSpec("v", rows=("A",)), "fixed(2)")
    assert cells.first()["value"] == round(50 * (0.1 - 0.3 + 0.01 + 0.2 - 7.77), 2)


def test_fixed_sums_exceed_64_bits(spark):
    layout = Layout(core=("A",))
    df = spark.range(40).selectExpr("cast(id as string) invariant_key", "id seq", "'x' A", "9.0e16 value")
    assert view_cells(df, layout, ViewSpec("v", rows=("A",)), "fixed(2)").first()["value"] == 40 * 9.0e16


def test_transforms(elements):
    register_transform("flip", lambda df, layout: df.withColumn("CCY", F.reverse("CCY")))
    register_transform("book", lambda df, layout, name: df.withColumn("BOOK", F.lit(name)))
    specs = [
        ViewSpec("f", rows=("CCY",), transform="flip"),
        ViewSpec("g", rows=("BOOK",), transform="book", transform_arg="One"),
    ]
    assert tuples(all_views(elements, LAYOUT, specs), "view", "row_keys", "value") == [
        ("f", ["DAC"], 5.0), ("f", ["DSU"], 35.0), ("g", ["One"], 40.0)
    ]
    with pytest.raises(ValueError):
        view_cells(elements, LAYOUT, ViewSpec("h", transform="missing"))


def test_filters_reach_the_file_scan(spark, elements, tmp_path):
    path = str(tmp_path / "elements")
    elements.write.parquet(path)
    spec = ViewSpec("v", rows=("TENOR",), filters={"CCY": ("USD", "CAD"), "METRIC": ("IR",)})
    plan = view_cells(spark.read.parquet(path), LAYOUT, spec)._jdf.queryExecution().executedPlan().toString()
    assert "In(CCY, [CAD,USD])" in plan
    assert "BOOK" not in plan


def test_unused_point_labels_are_not_read(spark, elements, tmp_path):
    path = str(tmp_path / "elements")
    elements.write.parquet(path)
    stored = spark.read.parquet(path)
    spec = ViewSpec("v", rows=("TENOR",), totals=("TENOR",))
    for cells in (view_cells(stored, LAYOUT, spec), all_views(stored, LAYOUT, [spec])):
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "points:array<struct<TENOR:string,value:double>>" in plan
    assert tuples(view_cells(stored, LAYOUT, spec)) == tuples(view_cells(elements, LAYOUT, spec))


def test_label_texts(spark):
    row = spark.range(1).select(
        split_key(join_key([F.lit("a"), F.lit(""), F.lit("")])).alias("cut"),
        split_key(F.lit("a\t\tb")).alias("inner"),
        cell_key([F.lit("c"), F.lit("d")], [F.lit("r")]).alias("key"),
        value_label(LAYOUT, "Nowhere").alias("unknown"),
        one_of(LAYOUT, "Nowhere", ["Nowhere"]).alias("self"),
    ).first()
    assert row["cut"] == ["a"] and row["inner"] == ["a", "", "b"] and row["key"] == "c\td\fr"
    assert row["unknown"] == "Nowhere" and row["self"]


def test_long_renames_move_sums_only(spark, elements):
    mapping = {f"x{i}": "Y" for i in range(200)} | {"CAD": "USD"}
    spec = ViewSpec("v", rows=("CCY",), renames={"CCY": mapping})
    alone = view_cells(elements, LAYOUT, spec)
    shared = all_views(elements, LAYOUT, [spec, ViewSpec("w", rows=("CCY",))])
    assert tuples(alone, "CCY", "value") == [("USD", 40.0)]
    assert tuples(shared.filter("view = 'v'").selectExpr("row_keys[0] AS k", "value")) == [("USD", 40.0)]
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    join, sums = plan.index("Join LeftOuter"), plan.rindex("Aggregate")
    assert join < sums, "the rename must come after the first sum"
