import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.model import Layout
from tallygrid.operators import drill as dr
from tallygrid.operators import elements as el
from tallygrid.operators.store import latest
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import view_cells
from tallygrid.sources import definitions as defs
from tallygrid.sources import feeds, tsv

TSV = "\n".join([
    "#ID#\tBOOK\tCCY\t#VALUE#\tNOTE",
    "1\tBook1\tUSD\t1\tfirst",
    "# a remark\tx\ty\t3\tz",
    "2\tBook1\tCAD\t0.1\t",
    "1\tBook2\tUSD\t5\tsecond",
    "3\tBook3",
]) + "\n"


@pytest.fixture()
def tsv_file(tmp_path):
    path = tmp_path / "elements.txt"
    path.write_text(TSV.replace("3\tBook3\n", ""), encoding="utf-8")
    return str(path)


def test_tsv(spark, tsv_file):
    rows, layout = tsv.read_tsv(spark, tsv_file)
    assert layout.core == ("#ID#", "BOOK", "CCY", "NOTE") and layout.is_core("NOTE")
    assert tuples(rows, "invariant_key", "BOOK", "value", "NOTE") == [
        ("1", "Book1", 1.0, "first"), ("1", "Book2", 5.0, "second"), ("2", "Book1", 0.10000000149011612, None)
    ]
    newest = latest(rows, layout)
    assert tuples(view_cells(newest, layout, ViewSpec("v", rows=("BOOK",))), "BOOK", "value") == [
        ("Book1", 0.10000000149011612), ("Book2", 5.0)
    ]


def test_tsv_empty_labels(spark, tmp_path):
    path = tmp_path / "empty.txt"
    path.write_text("ID\tA\t#VALUE#\tB\tC\n1\t\t1\t\tc\n\n2\ta\t2\t\t\n")
    rows, _ = tsv.read_tsv(spark, str(path))
    assert tuples(rows, "invariant_key", "A", "value", "B", "C") == [("1", "", 1.0, "", "c"), ("2", "a", 2.0, None, None)]
    nulls, _ = tsv.read_tsv(spark, str(path), empty_as_null=True)
    assert tuples(nulls, "invariant_key", "A", "B") == [("1", None, None), ("2", "a", None)]


def test_tsv_double(spark, tsv_file):
    rows, _ = tsv.read_tsv(spark, tsv_file, float32=False)
    assert (0.1,) in tuples(rows, "value")


def test_tsv_needs_a_value_column(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, str(tmp_path / "bad.txt"))


def test_tsv_bad_numbers(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("#ID#\t#VALUE#\n1\tx\n2\t2\n")
    with pytest.raises(Exception):
        tsv.read_tsv(spark, str(path))[0].collect()
    assert tuples(tsv.read_tsv(spark, str(path), mode="drop")[0], "invariant_key", "value") == [("2", 2.0)]


def test_tsv_order_over_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("#ID#\tN\t#VALUE#\n" + "".join(f"{i % 7}\t{i}\t{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, layout = tsv.read_tsv(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert tuples(latest(rows, layout), "invariant_key", "N") == sorted(
            (str(k), str(max(i for i in range(3000) if i % 7 == k))) for k in range(7)
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tsv_round_trip_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 1.5), ("b", "2", 2.5)], "id string, at string, v double")
    path = str(tmp_path / "out")
    tsv.write_tsv(df, path, ["id", "at"], "v")
    rows, _ = tsv.read_tsv(spark, path)
    assert tuples(rows, "invariant_key", "at", "value") == [("a", "1", 1.5), ("b", "2", 2.5)]
    stream, layout = tsv.stream_tsv(spark, path, ["id", "at", "#VALUE#"], seq="at")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert layout.core == ("id",)
    assert tuples(spark.read.parquet(str(tmp_path / "sink")), "invariant_key", "seq", "value") == [("a", 1, 1.5), ("b", 2, 2.5)]


DEFINITIONS = """
# a view
A.DESC=First: view
A.FILTER=CCY=USD
A.filter=CCY=CAD
A.FILTER=METRIC=IR=ignored
A.ROW=TENOR
A.ROW=BOOK
A.COL=CCY
A.TOTAL=TENOR
A.SET=BOOK=Alpha=X
A.SET=BOOK=Beta=X
A.HIDE=BOOK
A.CLASS=scaled
A.CLASS_ARG=2.0

B.ROW=CCY
END
not a definition
"""


def test_definitions(spark, tmp_path):
    path = tmp_path / "views.txt"
    path.write_text(DEFINITIONS)
    views = defs.load_views(spark, str(path))
    assert views["A"] == ViewSpec(
        "A", rows=("TENOR", "BOOK"), cols=("CCY",), totals=("TENOR",), hide=("BOOK",),
        filters={"CCY": ("USD", "CAD"), "METRIC": ("IR",)}, renames={"BOOK": {"Alpha": "X", "Beta": "X"}},
        description="First: view", transform="scaled", transform_arg="2.0",
    )
    assert views["B"] == ViewSpec("B", rows=("CCY",)) and views["B"].shown_description == "B"
    items = defs.read_definitions(spark, str(path))
    assert [r[0] for r in defs.view_names(items).collect()] == ["A", "B"]
    assert tuples(defs.view_headers(items)) == [("A", ["TENOR"], ["CCY"], "First: view"), ("B", ["CCY"], [""], "B")]


@pytest.mark.parametrize("line", ["nonsense", "A.NOPE=x", "A.FILTER=x", "A.SET=x=y", "A.FILTER=x="])
def test_bad_definitions_fail(spark, tmp_path, line):
    path = tmp_path / "views.txt"
    path.write_text(f"A.ROW=x\n{line}\n")
    with pytest.raises(Exception):
        defs.load_views(spark, str(path))


LAYOUT = Layout(core=("CCY", "BOOK"), perimeter=("METRIC", "TENOR"))
SCHEMA = (
    "invariant_key string, seq long, CCY string, BOOK string, "
    "points array<struct<METRIC: string, TENOR: string, value: double>>"
)


@pytest.fixture(scope="module")
def newest(spark):
    return spark.createDataFrame([
        ("1", 5, "USD", "Alpha", [("IR", "1Y", 1.0), ("NPV", None, 2.0)]),
        ("2", 9, "USD", None, [("IR", "1Y", 3.0)]),
        ("3", 7, "CAD", "Beta", [("IR", None, 4.0)]),
    ], SCHEMA)


SPEC = ViewSpec("v", rows=("TENOR", "Desk"), cols=("BOOK",), filters={"METRIC": ("IR",), "CCY": ("USD",)},
                renames={"BOOK": {"Alpha": "X", "Beta": "X", "-": "none"}})


def test_drill(spark, newest):
    def found(request, **options):
        return [r["value"] for r in dr.drill(newest, LAYOUT, SPEC, request, 10, **options).collect()]

    assert found({}) == [3.0, 1.0]
    assert found({"CCY": ["USD", "CAD"]}) == [3.0, 4.0, 1.0]
    assert found({"BOOK": ["X"], "CCY": ["USD", "CAD"]}) == [4.0, 1.0]
    assert found({"BOOK": ["none"]}) == [3.0]
    assert found({"BOOK": ["-"]}) == [3.0] and found({"BOOK": ["-"]}, compat=True) == []
    assert found({"TENOR": ["-"], "CCY": ["CAD"]}) == [4.0]
    assert found({"Desk": ["Desk"], "TENOR": ["Total"]}) == [3.0, 1.0]
    assert found({"Unknown": ["x"]}) == []
    assert found("BOOK=X\fCCY=USD\tCAD\fTENOR=Total\f=odd\fodd") == [4.0, 1.0]


def test_drill_limit_and_labels(spark, newest):
    rows = dr.drill_from(newest, LAYOUT, {"v": SPEC}, "v", {"CCY": ["USD", "CAD"]}, 2)
    assert rows.columns == ["value", "seq", "invariant_key", "CCY", "BOOK", "METRIC", "TENOR"]
    assert [tuple(r) for r in rows.collect()] == [(3.0, 9, "2", "USD", None, "IR", "1Y"), (4.0, 7, "3", "CAD", "Beta", "IR", None)]
    assert dr.drill(newest, LAYOUT, SPEC, {}, 0).count() == 0
    with pytest.raises(ValueError):
        dr.drill_from(newest, LAYOUT, {"v": SPEC}, "w", {}, 1)


def test_drill_agrees_with_the_cell(spark, newest):
    cells = view_cells(newest, LAYOUT, SPEC)
    for r in cells.collect():
        request = {"TENOR": [r["TENOR"]], "Desk": [r["Desk"]], "BOOK": [r["BOOK"]]}
        behind = dr.drill(newest, LAYOUT, SPEC, request, 100).agg(F.sum("value")).first()[0]
        assert behind == r["value"]


def test_snapshots_and_records(spark, tmp_path, newest):
    cells = view_cells(newest, LAYOUT, ViewSpec("v", rows=("CCY",), totals=("CCY",), hide=("CCY",)))
    path = str(tmp_path / "snapshot")
    feeds.write_snapshot(cells, path)
    feeds.write_snapshot(cells, path)
    assert tuples(spark.read.parquet(path), "CCY", "value") == [("Total", 10.0)]
    lines = str(tmp_path / "lines")
    feeds.write_records(spark.createDataFrame([("{}",)], "value string"), lines)
    assert spark.read.text(lines).count() == 1
    tsv.export_csv(el.flatten(newest, LAYOUT), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_tsv_missing_number_fails(spark, tmp_path):
    path = tmp_path / "missing.txt"
    path.write_text("ID\t#VALUE#\n1\t2\n3\n")
    with pytest.raises(Exception, match="no number in line"):
        tsv.read_tsv(spark, str(path))[0].collect()
    assert tuples(tsv.read_tsv(spark, str(path), mode="drop")[0], "invariant_key", "value") == [("1", 2.0)]


def test_tsv_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#ID#\tA\t#VALUE#\n1\tx\t2\n")
    (tmp_path / "b.txt").write_text("#ID#\t#VALUE#\tA\n1\t2\tx\n")
    with pytest.raises(Exception, match="unexpected header"):
        tsv.read_tsv(spark, str(tmp_path))[0].collect()


def test_tsv_roundtrip_of_empty_labels(spark, tmp_path):
    rows = spark.createDataFrame([("1", "", "x", 1.5), ("2", None, "y", 2.5)], "ID string, A string, B string, v double")
    path = str(tmp_path / "out")
    tsv.write_tsv(rows, path, ["ID", "A", "B"], "v")
    back, _ = tsv.read_tsv(spark, path, float32=False)
    assert tuples(back, "invariant_key", "A", "B", "value") == [("1", "", "x", 1.5), ("2", "", "y", 2.5)]


def test_many_requests_equal_one_by_one(spark, newest):
    texts = [
        "CCY=USD", "CCY=USD\tCAD\fTENOR=1Y", "CCY=Total\fTENOR=1Y", "CCY=x\fCCY=CAD", "nothing", "=x\fBOOK=-", "BOOK=Alpha\t", "FLOOR=1", "TENOR=-", "CCY=\t", "METRIC=NPV\fBOOK=Alpha", "",
    ]
    renaming = ViewSpec("r", rows=("TENOR", "MADE UP"), cols=("CCY",), renames={"CCY": {"USD": "D", "CAD": "D"}}, filters={"METRIC": ("IR",)})
    texts += ["CCY=D", "CCY=D\tUSD\fMADE UP=MADE UP"]
    specs = {"v": SPEC, "r": renaming, "plain": ViewSpec("plain")}
    asked = [(f"{v} {i}", v, t) for v in specs for i, t in enumerate(texts)]
    requests = spark.createDataFrame(asked, "request_id string, view string, request string")
    found = {}
    for r in dr.drill_many(newest, LAYOUT, specs, requests, 3).orderBy("request_id", "rank").collect():
        found.setdefault(r["request_id"], []).append(tuple(r)[2:])
    for name, view, text in asked:
        assert found.get(name, []) == [tuple(r) for r in dr.drill(newest, LAYOUT, specs[view], text, 3).collect()], (view, text)
    with pytest.raises(Exception, match="no view named w"):
        dr.drill_many(newest, LAYOUT, specs, spark.createDataFrame([("a", "w", "CCY=USD")], requests.schema), 3).collect()
