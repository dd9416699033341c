"""Number display, label order, and the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import display as d
from tallygrid.operators import grid as g
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import view_cells
from tallygrid.session import checkpointed

from .inputs import EVENTS, EVENTS_SQL, FLAGS, FLAGS_SQL, MONEY, events, flagged_lines, table, total
from .registry import query

SHOWN = """CASE WHEN c_acctbal < 0
       THEN '(' || format('{:,}', CAST(abs(round_even(c_acctbal, 0)) AS BIGINT)) || ')'
       ELSE format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT)) END"""


@query(f"SELECT c_custkey, {SHOWN} AS shown FROM customer")
def accounting_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", d.accounting(F.col("c_acctbal")).alias("shown"))


@query("SELECT c_custkey, round_even(c_acctbal, 0) + 0.0 AS number FROM customer")
def accounting_parse(spark, sf):
    shown = d.accounting(F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", (d.parse_accounting(shown) + 0.0).alias("number"))


@query("SELECT c_custkey, format('{:,}', CAST(floor(c_acctbal + 0.5) AS BIGINT)) AS shown FROM customer")
def rounded_display(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", d.rounded(F.col("c_acctbal")).alias("shown"))


@query("""
SELECT CAST(SUM(CAST(round_even(c_acctbal, 0) AS BIGINT)) AS DOUBLE) AS total
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def selection_total(spark, sf):
    """Sum of the displayed balances of the customers of two segments."""
    customers = table(spark, sf, "customer")
    shown = customers.select("c_custkey", d.accounting(F.col("c_acctbal")).alias("shown"))
    picked = customers.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return g.selection_total(shown, picked, ["c_custkey"])


PRIORITY_RANK = {"5-LOW": 1, "1-URGENT": 2, "3-MEDIUM": 3}


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN '1' WHEN '1-URGENT' THEN '2' WHEN '3-MEDIUM' THEN '3'
       ELSE o_orderpriority END AS sort_text
FROM orders
""")
def label_rank(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", d.rank_text(F.col("o_orderpriority"), PRIORITY_RANK).alias("sort_text")
    )


AS_OF = "1998-01-01"


def _tenor():
    """A tenor in each of the known spellings, by the priority and status of an order."""
    count = (F.col("o_totalprice") / 10000).cast("int").cast("string")
    date = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(date, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(date, "MMM-yy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(count, F.lit("W")))
        .when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), F.concat(count, F.lit("M")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(count, F.lit("Y")))
        .when(F.col("o_orderstatus") == "F", F.date_format(date, "yyyyMMdd"))
        .when(F.col("o_orderstatus") == "O", F.concat(count, F.lit("D")))
        .otherwise(F.lit("SPOT"))
    )


TENOR_SQL = """
CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
     WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%b-%y')
     WHEN o_orderpriority = '3-MEDIUM' THEN n || 'W'
     WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN n || 'M'
     WHEN o_orderpriority = '5-LOW' THEN n || 'Y'
     WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y%m%d')
     WHEN o_orderstatus = 'O' THEN n || 'D' ELSE 'SPOT' END
"""

# A two-digit year is read as 20yy.
DAYS_SQL = """
CASE WHEN o_orderpriority = '1-URGENT' THEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))
     WHEN o_orderpriority = '2-HIGH' THEN date_diff('day', DATE '1998-01-01',
          make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), 15))
     WHEN o_orderpriority = '3-MEDIUM' THEN 7 * CAST(n AS BIGINT)
     WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 31 * CAST(n AS BIGINT)
     WHEN o_orderpriority = '5-LOW' THEN 365 * CAST(n AS BIGINT)
     WHEN o_orderstatus = 'F' THEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))
     WHEN o_orderstatus = 'O' THEN CAST(n AS BIGINT) ELSE 0 END
"""

TENORS_SQL = f"""
SELECT o_orderkey, {TENOR_SQL} AS tenor, CAST({DAYS_SQL} AS BIGINT) AS days
FROM (SELECT *, CAST(CAST(floor(o_totalprice / 10000) AS INT) AS VARCHAR) AS n FROM orders)
"""


@query(f"SELECT *, right('000000' || CAST(days AS VARCHAR), 7) AS sort_text FROM ({TENORS_SQL})")
def tenor_days(spark, sf):
    labelled = table(spark, sf, "orders").select("o_orderkey", _tenor().alias("tenor"))
    days = labelled.withColumn("days", d.tenor_days(F.col("tenor"), AS_OF))
    return days.withColumn("sort_text", d.tenor_text(F.col("days")))


GRID = ViewSpec(
    "grid",
    rows=("l_returnflag", "SHIP_YEAR"),
    cols=("l_linestatus", "o_orderpriority"),
    totals=("SHIP_YEAR", "o_orderpriority"),
)

GRID_RANKS = {"o_orderpriority": PRIORITY_RANK}


def _grid_cells(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    joined = flagged_lines(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return checkpointed(view_cells(joined, FLAGS.with_(core=(*FLAGS.core, "o_orderpriority")), GRID, MONEY))


GRID_SQL = f"""
  SELECT l_linestatus, CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority,
         l_returnflag, CASE WHEN GROUPING(SHIP_YEAR) = 1 THEN 'Total' ELSE SHIP_YEAR END AS SHIP_YEAR,
         {total('l_extendedprice')}
  FROM ({FLAGS_SQL}) JOIN orders ON l_orderkey = o_orderkey
  GROUP BY GROUPING SETS ((l_linestatus, o_orderpriority, l_returnflag, SHIP_YEAR), (l_linestatus, l_returnflag, SHIP_YEAR),
                          (l_linestatus, o_orderpriority, l_returnflag), (l_linestatus, l_returnflag))
"""

ROWS_SQL = f"""
  SELECT l_returnflag, SHIP_YEAR,
         row_number() OVER (ORDER BY l_returnflag, CASE WHEN SHIP_YEAR = 'Total' THEN 0 ELSE 1 END, SHIP_YEAR) - 1 AS position
  FROM (SELECT DISTINCT l_returnflag, SHIP_YEAR FROM ({GRID_SQL}))
"""

COLUMNS_SQL = f"""
  SELECT l_linestatus, o_orderpriority,
         row_number() OVER (ORDER BY l_linestatus, CASE o_orderpriority WHEN 'Total' THEN 0 WHEN '5-LOW' THEN 1
             WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END, o_orderpriority) - 1 AS position
  FROM (SELECT DISTINCT l_linestatus, o_orderpriority FROM ({GRID_SQL}))
"""


@query(f"""
SELECT 'row' AS side, l_returnflag AS first, SHIP_YEAR AS second, position FROM ({ROWS_SQL})
UNION ALL
SELECT 'col', l_linestatus, o_orderpriority, position FROM ({COLUMNS_SQL})
""")
def grid_order(spark, sf):
    cells = _grid_cells(spark, sf)

    def side(name: str, rows: bool, first: str, second: str):
        ordered = g.grid_order(cells, GRID, rows, ranks=GRID_RANKS)
        return ordered.select(F.lit(name).alias("side"), F.col(first).alias("first"), F.col(second).alias("second"), "position")

    return side("row", True, "l_returnflag", "SHIP_YEAR").unionByName(
        side("col", False, "l_linestatus", "o_orderpriority")
    )


# The total row of flag N and the total column of status F are open, all others are closed.
VISIBLE_ROWS_SQL = f"""
  SELECT l_returnflag, SHIP_YEAR, COALESCE(last_value(state IGNORE NULLS) OVER (
           ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hidden_row
  FROM (SELECT *, CASE WHEN SHIP_YEAR = 'Total' THEN l_returnflag <> 'N' END AS state FROM ({ROWS_SQL}))
"""

VISIBLE_COLUMNS_SQL = f"""
  SELECT l_linestatus, o_orderpriority, o_orderpriority <> 'Total' AND l_linestatus <> 'F' AS hidden_col FROM ({COLUMNS_SQL})
"""


def _open_rows(cells):
    return cells.filter("l_returnflag = 'N' AND SHIP_YEAR = 'Total'").select("l_returnflag", "SHIP_YEAR")


def _open_columns(cells):
    return cells.filter("l_linestatus = 'F' AND o_orderpriority = 'Total'").select("l_linestatus", "o_orderpriority")


@query(VISIBLE_ROWS_SQL)
def visible_rows(spark, sf):
    cells = _grid_cells(spark, sf)
    return g.row_visibility(cells, GRID, _open_rows(cells), ranks=GRID_RANKS)


@query(VISIBLE_COLUMNS_SQL)
def visible_cols(spark, sf):
    cells = _grid_cells(spark, sf)
    return g.column_visibility(cells, GRID, _open_columns(cells), ranks=GRID_RANKS)


@query(f"""
SELECT c.* FROM ({GRID_SQL}) c
JOIN ({VISIBLE_ROWS_SQL}) r ON c.l_returnflag = r.l_returnflag AND c.SHIP_YEAR = r.SHIP_YEAR AND NOT hidden_row
JOIN ({VISIBLE_COLUMNS_SQL}) k ON c.l_linestatus = k.l_linestatus AND c.o_orderpriority = k.o_orderpriority AND NOT hidden_col
""")
def visible_grid(spark, sf):
    cells = _grid_cells(spark, sf)
    shown = g.visible_grid(cells, GRID, _open_rows(cells), _open_columns(cells), ranks=GRID_RANKS)
    return shown.drop("is_total", "hidden")


PIVOT = ViewSpec("pivot", rows=("SHIP_YEAR",), cols=("l_returnflag", "l_linestatus"), totals=("l_linestatus",))


def _pivot_sql(extra: str = "", years: str = "") -> str:
    """One conditional sum per column label."""
    picks = [
        f"""CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = '{flag}'{test}) AS DOUBLE) AS "{flag}/{shown}" """
        for flag in "ANR"
        for shown, test in (("F", " AND l_linestatus = 'F'"), ("O", " AND l_linestatus = 'O'"), ("Total", ""))
    ]
    return f"SELECT SHIP_YEAR, {', '.join(picks)}{extra} FROM ({FLAGS_SQL}) {years} GROUP BY SHIP_YEAR"


@query(_pivot_sql())
def grid_pivot(spark, sf):
    cells = view_cells(flagged_lines(spark, sf), FLAGS, PIVOT, MONEY)
    return g.wide(cells, PIVOT, separator="/")


@query(f"""
SELECT SHIP_YEAR, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS "A/F"
FROM ({FLAGS_SQL}) WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY SHIP_YEAR
""")
def drop_empty(spark, sf):
    """Cells deleted down to one column and the early years; the emptied rows and columns leave the grid."""
    cells = view_cells(flagged_lines(spark, sf), FLAGS, PIVOT, MONEY)
    kept = F.concat_ws("/", "l_returnflag", "l_linestatus") == "A/F"
    emptied = cells.withColumn("value", F.when(kept & (F.col("SHIP_YEAR") < "1999"), F.col("value")))
    return g.without_empty(g.wide(emptied, PIVOT, separator="/"), ["SHIP_YEAR"])


WIDE = ViewSpec("hours", rows=("event_type",), cols=("DAY", "HOUR"))
PAGE = 50


@query(f"""
SELECT CAST(col // {PAGE} AS BIGINT) AS page, CAST(col % {PAGE} AS INT) AS place, DAY, HOUR, event_type, value FROM (
  SELECT dense_rank() OVER (ORDER BY DAY, HOUR) - 1 AS col, DAY, HOUR, event_type, {total('value')}
  FROM (SELECT *, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS HOUR FROM ({EVENTS_SQL})) GROUP BY DAY, HOUR, event_type)
""")
def grid_pages(spark, sf):
    """A grid of hundreds of columns, one per hour, in pages."""
    rows = events(spark, sf).withColumn("HOUR", F.lpad(F.hour("ts").cast("string"), 2, "0"))
    cells = view_cells(rows, EVENTS.with_(core=("event_type", "DAY", "HOUR")), WIDE, MONEY)
    headers, grid = g.pages(cells, WIDE, PAGE)
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"c{i}").alias("value")) for i in range(PAGE)])
    long = grid.select("page", "event_type", F.inline(places)).filter("value is not null")
    return long.join(headers, ["page", "place"]).select("page", "place", "DAY", "HOUR", "event_type", "value")
