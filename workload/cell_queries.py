"""Cells, labels, totals, many views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.labels import cell_key, core_label, join_key, split_key, value_label
from tallygrid.model import Layout
from tallygrid.operators.cells import visible
from tallygrid.operators.changes import as_json, update_records
from tallygrid.operators.elements import flatten
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import all_views, register_transform, view_cells

from .inputs import (
    CENTS, FLAGS, LINES, LINES_SQL, MONEY, ORDER_LINES, ORDERS, flagged_lines, lines, order_lines, orders, table, total,
)
from .registry import query

CELL_SUM = ViewSpec(
    "priority by flag",
    rows=("l_returnflag",),
    cols=("o_orderpriority",),
    filters={"o_orderstatus": ("F", "O"), "l_linestatus": ("F",)},
)


@query(f"""
SELECT o_orderpriority, l_returnflag, {total('l_extendedprice')}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('F', 'O') AND l_linestatus = 'F'
GROUP BY o_orderpriority, l_returnflag
""")
def cell_sum(spark, sf):
    cells = view_cells(order_lines(spark, sf), ORDER_LINES, CELL_SUM, MONEY)
    return cells.select("o_orderpriority", "l_returnflag", "value")


ELEMENT_CELLS = ViewSpec(
    "metric by band",
    rows=("BAND",),
    cols=("METRIC", "l_linestatus"),
    filters={"METRIC": ("QTY", "TAX"), "l_returnflag": ("R", "A")},
)


@query(f"""
SELECT METRIC, l_linestatus, COALESCE(BAND, '-') AS BAND, {total('value')}
FROM ({LINES_SQL})
WHERE METRIC IN ('QTY', 'TAX') AND l_returnflag IN ('R', 'A')
GROUP BY ALL
""")
def element_cells(spark, sf):
    return view_cells(lines(spark, sf), LINES, ELEMENT_CELLS, MONEY).drop("is_total", "hidden")


@query("""
SELECT line_key, l_shipdate, l_partkey, pos, l_returnflag AS core_flag, CAST(NULL AS VARCHAR) AS core_metric,
       COALESCE(BAND, '-') AS band, 'DESK' AS desk, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value
FROM (%s)
""" % LINES_SQL)
def value_rows(spark, sf):
    return flatten(lines(spark, sf), LINES).select(
        "line_key", "l_shipdate", "l_partkey", "pos",
        core_label(LINES, "l_returnflag").alias("core_flag"),
        core_label(LINES, "METRIC").alias("core_metric"),
        value_label(LINES, "BAND").alias("band"),
        value_label(LINES, "DESK").alias("desk"),
        F.col("value").cast(CENTS).cast("double").alias("value"),
    )


@query(f"""
SELECT COALESCE(NULLIF(o_orderstatus, 'P'), '-') AS "STATUS", o_orderpriority, {total('o_totalprice')}
FROM orders WHERE COALESCE(NULLIF(o_orderstatus, 'P'), '-') IN ('-', 'F')
GROUP BY ALL
""")
def null_label(spark, sf):
    spec = ViewSpec("nulls", rows=("o_orderpriority",), cols=("STATUS",), filters={"STATUS": ("-", "F")})
    return view_cells(orders(spark, sf), ORDERS, spec, MONEY).drop("is_total", "hidden")


RENAMED = ViewSpec(
    "renamed",
    rows=("o_orderpriority",),
    cols=("STATUS",),
    filters={"o_orderpriority": ("1-URGENT", "2-HIGH", "5-LOW")},
    renames={"o_orderpriority": {"1-URGENT": "SOON", "2-HIGH": "SOON"}, "STATUS": {"-": "NONE"}},
)


@query(f"""
SELECT CASE COALESCE(NULLIF(o_orderstatus, 'P'), '-') WHEN '-' THEN 'NONE'
            ELSE COALESCE(NULLIF(o_orderstatus, 'P'), '-') END AS "STATUS",
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SOON' ELSE o_orderpriority END AS o_orderpriority,
       {total('o_totalprice')}
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
GROUP BY ALL
""")
def value_rename(spark, sf):
    return view_cells(orders(spark, sf), ORDERS, RENAMED, MONEY).drop("is_total", "hidden")


@query(f"""
SELECT 'Region ' || (c_nationkey % 5) AS c_nationkey, {total('c_acctbal')}
FROM customer GROUP BY ALL
""")
def value_rename_long(spark, sf):
    """A rename of a hundred entries goes through a lookup table."""
    layout = Layout(key="c_custkey", seq=("c_custkey",), core=("c_nationkey",), value="c_acctbal")
    regions = {str(n): f"Region {n % 5}" for n in range(100)}
    spec = ViewSpec("nations", rows=("c_nationkey",), renames={"c_nationkey": regions})
    return view_cells(table(spark, sf, "customer"), layout, spec, MONEY).select("c_nationkey", "value")


@query(f"""
SELECT '' AS col_label, 'Total' AS "Total", o_orderpriority, {total('o_totalprice')}
FROM orders GROUP BY ALL
""")
def constant_label(spark, sf):
    spec = ViewSpec("constant", rows=("Total", "o_orderpriority"))
    return view_cells(orders(spark, sf), ORDERS, spec, MONEY).drop("is_total", "hidden")


@query(f"""
SELECT o_orderpriority, '' AS row_label, {total('o_totalprice')}
FROM orders WHERE 'TYPE' IN ('P&L', 'TYPE') GROUP BY ALL
""")
def unknown_filter_attr(spark, sf):
    spec = ViewSpec("unknown", cols=("o_orderpriority",), filters={"TYPE": ("P&L", "TYPE")})
    return view_cells(orders(spark, sf), ORDERS, spec, MONEY).drop("is_total", "hidden")


TOTALS = ViewSpec(
    "totals",
    rows=("l_returnflag",),
    cols=("o_orderpriority", "l_linestatus"),
    totals=("l_returnflag", "l_linestatus"),
    filters={"o_orderstatus": ("F", "O")},
)


def _totals_sql(sets: str) -> str:
    return f"""
SELECT CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN GROUPING(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END AS l_linestatus,
       CASE WHEN GROUPING(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag,
       {total('l_extendedprice')},
       GROUPING(o_orderpriority) + GROUPING(l_linestatus) + GROUPING(l_returnflag) > 0 AS is_total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('F', 'O')
GROUP BY GROUPING SETS ({sets})
"""


@query(_totals_sql("""
 (o_orderpriority, l_linestatus, l_returnflag), (o_orderpriority, l_returnflag),
 (o_orderpriority, l_linestatus), (o_orderpriority)"""))
def totals_documented(spark, sf):
    return view_cells(order_lines(spark, sf), ORDER_LINES, TOTALS, MONEY).drop("hidden")


@query(_totals_sql("""
 (o_orderpriority, l_linestatus, l_returnflag), (o_orderpriority), (l_returnflag),
 (o_orderpriority, l_returnflag)"""))
def totals_observed(spark, sf):
    return view_cells(order_lines(spark, sf), ORDER_LINES, TOTALS, MONEY, rule="observed").drop("hidden")


HIDDEN = ViewSpec("hidden", rows=("SHIP_YEAR",), cols=("l_returnflag",), totals=("SHIP_YEAR",), hide=("SHIP_YEAR",))


@query(f"""
SELECT l_returnflag, 'Total' AS "SHIP_YEAR", {total('l_extendedprice')}
FROM lineitem GROUP BY ALL
""")
def hidden_totals_only(spark, sf):
    cells = visible(view_cells(flagged_lines(spark, sf), FLAGS, HIDDEN, MONEY))
    return cells.drop("is_total", "hidden")


VIEWS = (
    ViewSpec("bands", rows=("BAND",), cols=("METRIC",), filters={"METRIC": ("QTY",)}, totals=("BAND",)),
    ViewSpec("flags", rows=("l_returnflag",), cols=("METRIC", "l_linestatus"), totals=("l_linestatus",),
             renames={"METRIC": {"DISC": "RATE", "TAX": "RATE"}}, filters={"METRIC": ("DISC", "TAX")}),
    ViewSpec("all", rows=("METRIC",), hide=("METRIC",), totals=("METRIC",)),
)


@query(f"""
WITH v AS ({LINES_SQL}),
bands AS (
  SELECT 'bands' AS view, METRIC AS col_key, CASE WHEN GROUPING(b) = 1 THEN 'Total' ELSE b END AS row_key,
         {total('value')}, GROUPING(b) > 0 AS is_total, FALSE AS hidden
  FROM (SELECT *, COALESCE(BAND, '-') AS b FROM v) WHERE METRIC = 'QTY' GROUP BY GROUPING SETS ((METRIC, b), (METRIC))),
flags AS (
  SELECT 'flags' AS view, 'RATE' || chr(9) || CASE WHEN GROUPING(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END AS col_key,
         l_returnflag AS row_key, {total('value')}, GROUPING(l_linestatus) > 0 AS is_total, FALSE AS hidden
  FROM v WHERE METRIC IN ('DISC', 'TAX') GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))),
every AS (
  SELECT 'all' AS view, '' AS col_key, CASE WHEN GROUPING(METRIC) = 1 THEN 'Total' ELSE METRIC END AS row_key,
         {total('value')}, GROUPING(METRIC) > 0 AS is_total, GROUPING(METRIC) = 0 AS hidden
  FROM v GROUP BY GROUPING SETS ((METRIC), ()))
SELECT * FROM bands UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM every
""")
def multi_view(spark, sf):
    cells = all_views(lines(spark, sf), LINES, VIEWS, MONEY)
    return cells.select(
        "view", F.concat_ws("\t", "col_keys").alias("col_key"), F.concat_ws("\t", "row_keys").alias("row_key"),
        "value", "is_total", "hidden",
    )


@query(f"""
SELECT view, COUNT(*) AS cells FROM (
  SELECT DISTINCT 'bands' AS view, METRIC AS a, COALESCE(BAND, '-') AS b, '' AS c FROM ({LINES_SQL}) WHERE METRIC = 'QTY'
  UNION ALL
  SELECT DISTINCT 'flags', 'RATE', l_linestatus, l_returnflag FROM lineitem
  UNION ALL
  SELECT DISTINCT 'all', METRIC, '', '' FROM ({LINES_SQL}))
GROUP BY view
""")
def cells_per_view(spark, sf):
    cells = all_views(lines(spark, sf), LINES, VIEWS, MONEY, rule="none")
    return cells.groupBy("view").agg(F.count(F.lit(1)).alias("cells"))


def _scaled(df: DataFrame, layout, factor: str) -> DataFrame:
    return df.withColumn(layout.value, F.col(layout.value) * F.lit(float(factor)))


def _only_open(df: DataFrame, layout) -> DataFrame:
    return df.filter(F.col("o_orderstatus") == "O")


register_transform("scaled", _scaled)
register_transform("only open", _only_open)


@query(f"""
SELECT 'doubled' AS view, o_orderpriority AS label, {total('o_totalprice * 2')} FROM orders GROUP BY ALL
UNION ALL
SELECT 'open' AS view, o_orderpriority AS label, {total('o_totalprice')} FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL
""")
def view_transform(spark, sf):
    specs = (
        ViewSpec("doubled", rows=("o_orderpriority",), transform="scaled", transform_arg="2.0"),
        ViewSpec("open", rows=("o_orderpriority",), transform="only open"),
    )
    cells = all_views(orders(spark, sf), ORDERS, specs, MONEY)
    return cells.select("view", F.col("row_keys")[0].alias("label"), "value")


MESSAGES = ViewSpec("cells", rows=("l_returnflag",), cols=("SHIP_YEAR", "l_linestatus"), totals=("l_returnflag",))


@query("""
SELECT 'cells' AS "viewName", 'UPD' AS command,
       CASE WHEN GROUPING(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS row_key,
       strftime(l_shipdate, '%Y') || chr(9) || l_linestatus AS col_key,
       format('{:,}', CAST(round_even(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS BIGINT)) AS value
FROM lineitem
GROUP BY GROUPING SETS ((strftime(l_shipdate, '%Y') || chr(9) || l_linestatus, l_returnflag),
                        (strftime(l_shipdate, '%Y') || chr(9) || l_linestatus))
""")
def cell_messages(spark, sf):
    """Records go out as JSON text; here they are read back into columns."""
    cells = view_cells(flagged_lines(spark, sf), FLAGS, MESSAGES, MONEY)
    text = as_json(update_records(cells, MESSAGES))
    schema = "viewName string, command string, rowKeys array<string>, colKeys array<string>, value string"
    back = text.select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select(
        "viewName", "command", F.concat_ws("\t", "rowKeys").alias("row_key"),
        F.concat_ws("\t", "colKeys").alias("col_key"), "value",
    )


@query("""
SELECT DISTINCT l_returnflag || chr(9) || l_linestatus || chr(12) || strftime(l_shipdate, '%Y') AS cell_key,
       l_returnflag || chr(9) || l_linestatus AS col_key, 2 AS levels, l_linestatus AS second, 1 AS kept
FROM lineitem
""")
def cell_keys(spark, sf):
    """Labels joined to one text and split again; a trailing empty label is not kept by the split."""
    labels = flagged_lines(spark, sf).select("l_returnflag", "l_linestatus", "SHIP_YEAR").distinct()
    cols = [F.col("l_returnflag"), F.col("l_linestatus")]
    joined = join_key(cols)
    return labels.select(
        cell_key(cols, [F.col("SHIP_YEAR")]).alias("cell_key"),
        joined.alias("col_key"),
        F.size(split_key(joined)).alias("levels"),
        split_key(joined)[1].alias("second"),
        F.size(split_key(join_key([F.col("l_returnflag"), F.lit(""), F.lit("")]))).alias("kept"),
    )
