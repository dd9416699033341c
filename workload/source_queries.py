"""View definitions, attributes, and element files, written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators.changes import as_json, header_records
from tallygrid.operators.elements import attribute_catalog
from tallygrid.operators.grid import wide
from tallygrid.operators.ordering import numbered
from tallygrid.operators.store import latest
from tallygrid.plans.view import view_cells
from tallygrid.session import new_work_dir
from tallygrid.sources import definitions as defs
from tallygrid.sources import tsv

from .display_queries import PIVOT, _pivot_sql
from .inputs import FLAGS, LINES, LINES_SQL, MONEY, flagged_lines, lines, table
from .registry import query


def _definitions(spark, sf):
    """A view per part, written as definition text and parsed again.

    Parts of size 1 have no description, parts of other sizes hide their type; comments and blank lines are mixed in.
    """
    view = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))

    def line(item: str, *value):
        return F.concat(view, F.lit(f".{item}="), *value)

    text = F.array_compact(F.array(
        F.concat(F.lit("# view of "), F.col("p_name")),
        F.lit(""),
        F.when(F.col("p_size") > 1, line("DESC", F.col("p_name"))),
        line("row", F.lit("p_type")),
        line("ROW", F.lit("p_brand")),
        line("COL", F.lit("p_size")),
        line("COL", F.col("p_type")),
        F.when(F.col("p_size") > 1, line("HIDE", F.lit("p_brand"))),
        F.when(F.col("p_size") > 25, line("HIDE", F.col("p_type"))),
        line("FILTER", F.lit("p_brand="), F.col("p_brand")),
        line("SET", F.lit("p_type="), F.col("p_type"), F.lit("=OTHER")),
    ))
    path = new_work_dir(spark, "definitions")
    table(spark, sf, "part").select(F.explode(text).alias("value")).write.text(path)
    return defs.read_definitions(spark, path)


@query("""
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS view, l.item AS item, l.val AS val, row_number() OVER (PARTITION BY p_partkey ORDER BY l.at) - 1 AS pos
FROM (SELECT *, unnest([
        {'at': 0, 'item': 'DESC', 'val': CASE WHEN p_size > 1 THEN p_name END},
        {'at': 1, 'item': 'ROW', 'val': 'p_type'}, {'at': 2, 'item': 'ROW', 'val': 'p_brand'},
        {'at': 3, 'item': 'COL', 'val': 'p_size'}, {'at': 4, 'item': 'COL', 'val': p_type},
        {'at': 5, 'item': 'HIDE', 'val': CASE WHEN p_size > 1 THEN 'p_brand' END},
        {'at': 6, 'item': 'HIDE', 'val': CASE WHEN p_size > 25 THEN p_type END},
        {'at': 7, 'item': 'FILTER', 'val': 'p_brand=' || p_brand},
        {'at': 8, 'item': 'SET', 'val': 'p_type=' || p_type || '=OTHER'}]) AS l
      FROM part)
WHERE l.val IS NOT NULL
""")
def view_defs(spark, sf):
    items = _definitions(spark, sf)
    chunk = F.struct("file", "block", F.floor(F.col("line") / 4096))
    placed = numbered(items, ["view"], ["file", "block", "line"], chunk, "pos")
    return placed.select("view", "item", "val", "pos")


@query("""
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS view,
       CASE WHEN p_size > 1 THEN 'p_type' ELSE 'p_type' || chr(9) || 'p_brand' END AS row_labels,
       CASE WHEN p_size > 25 THEN 'p_size' ELSE 'p_size' || chr(9) || p_type END AS col_labels,
       CASE WHEN p_size > 1 THEN p_name ELSE 'P' || CAST(p_partkey AS VARCHAR) END AS description
FROM part
""")
def view_header(spark, sf):
    found = defs.view_headers(_definitions(spark, sf))
    return found.select(
        "view", F.concat_ws("\t", "row_labels").alias("row_labels"), F.concat_ws("\t", "col_labels").alias("col_labels"),
        "description",
    )


@query("""
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS "viewName", 'DIM' AS command,
       CASE WHEN p_size > 1 THEN p_name ELSE 'P' || CAST(p_partkey AS VARCHAR) END AS description,
       CASE WHEN p_size > 1 THEN 'p_type' ELSE 'p_type' || chr(9) || 'p_brand' END AS row_labels,
       CASE WHEN p_size > 25 THEN 'p_size' ELSE 'p_size' || chr(9) || p_type END AS col_labels
FROM part
""")
def view_header_records(spark, sf):
    """The header record of each view as JSON text, read back into columns."""
    text = as_json(header_records(defs.view_headers(_definitions(spark, sf))))
    schema = "viewName string, command string, rowKeys array<string>, colKeys array<string>, description string"
    back = text.select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select(
        "viewName", "command", "description",
        F.concat_ws("\t", "rowKeys").alias("row_labels"), F.concat_ws("\t", "colKeys").alias("col_labels"),
    )


@query("SELECT 'P' || CAST(p_partkey AS VARCHAR) AS view FROM part")
def view_names(spark, sf):
    return defs.view_names(_definitions(spark, sf))


@query(f"""
SELECT 'l_returnflag' AS name, 0 AS position, TRUE AS is_core, COUNT(l_returnflag) AS labelled FROM ({LINES_SQL})
UNION ALL SELECT 'l_linestatus', 1, TRUE, COUNT(l_linestatus) FROM ({LINES_SQL})
UNION ALL SELECT 'METRIC', 2, FALSE, COUNT(METRIC) FROM ({LINES_SQL})
UNION ALL SELECT 'BAND', 3, FALSE, COUNT(BAND) FROM ({LINES_SQL})
""")
def attributes(spark, sf):
    return attribute_catalog(lines(spark, sf), LINES)


FILE_LABELS = ["o_custkey", "o_orderpriority", "o_orderstatus", "STATUS"]


@query(f"""
SELECT o_custkey AS invariant_key, o_orderpriority, STATUS, o_totalprice AS value
FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority, NULLIF(o_orderstatus, 'P') AS STATUS,
             o_totalprice, o_orderkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
""")
def tsv_source(spark, sf):
    """Orders as a tab-separated file in key order; of the orders of a customer the last line counts."""
    path = new_work_dir(spark, "tsv")
    source = table(spark, sf, "orders").withColumn("STATUS", F.nullif("o_orderstatus", F.lit("P")))
    tsv.write_tsv(source.orderBy("o_orderkey"), path, FILE_LABELS, "o_totalprice")
    rows, layout = tsv.read_tsv(spark, path, float32=False, empty_as_null=True)
    return latest(rows, layout).select("invariant_key", "o_orderpriority", "STATUS", "value")


@query("SELECT o_orderkey AS invariant_key, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS value FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders)")
def tsv_float32(spark, sf):
    """Numbers of a file pass through 32 bits."""
    path = new_work_dir(spark, "tsv32")
    tsv.write_tsv(table(spark, sf, "orders"), path, ["o_orderkey", "o_orderstatus"], "o_totalprice")
    rows, _ = tsv.read_tsv(spark, path)
    return rows.select("invariant_key", "value")


@query(_pivot_sql())
def grid_export(spark, sf):
    """A grid exported as comma-separated text and read back."""
    cells = view_cells(flagged_lines(spark, sf), FLAGS, PIVOT, MONEY)
    grid = wide(cells, PIVOT, separator="/")
    path = new_work_dir(spark, "export")
    tsv.export_csv(grid, path)
    numbers = ", ".join(f"`{c}` double" for c in grid.columns if c != "SHIP_YEAR")
    return spark.read.schema(f"SHIP_YEAR string, {numbers}").option("header", True).csv(path)
