"""Newest versions, the change log, lookups, differences, element copies, drill-through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.model import Layout
from tallygrid.functions.display import accounting
from tallygrid.operators import difference as diff
from tallygrid.operators import drill as dr
from tallygrid.operators import elements as el
from tallygrid.operators import store as st
from tallygrid.operators.changes import as_json, cell_changes, update_records, vanished, vanished_axis_records
from tallygrid.operators.drill import drill, drill_from
from tallygrid.operators.grid import wide
from tallygrid.operators.ordering import numbered
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import all_views, view_cells
from tallygrid.session import checkpointed, new_work_dir
from tallygrid.sources.feeds import write_snapshot

from .inputs import (
    CENTS, EVENTS, EVENTS_SQL, LINES, LINES_SQL, MONEY, PAIRS, PAIRS_SQL, event_day, events, lines, pairs, table, total,
)
from .registry import query

CENT = "CAST(CAST({0} AS DECIMAL(18,2)) AS DOUBLE)"


def cents(name: str = "value"):
    return F.col(name).cast(CENTS).cast("double").alias(name)


NEWEST_SQL = f"SELECT * FROM ({EVENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(NEWEST_SQL)
def latest_per_key(spark, sf):
    return st.latest(events(spark, sf), EVENTS)


@query(f"""
SELECT line_key, l_shipdate, l_partkey, pos, METRIC, BAND, {CENT.format('value')} AS value
FROM ({LINES_SQL})
QUALIFY rank() OVER (PARTITION BY line_key ORDER BY l_shipdate DESC, l_partkey DESC) = 1
""")
def latest_rows(spark, sf):
    rows = el.flatten(lines(spark, sf), LINES)
    newest = st.latest_rows(rows, LINES)
    return newest.select("line_key", "l_shipdate", "l_partkey", "pos", "METRIC", "BAND", cents())


LOG_SQL = f"""
SELECT user_id, ts, event_id, event_type, DAY, sign, sign * value AS value, applied
FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM ({EVENTS_SQL})) e,
LATERAL (SELECT unnest([1, -1]) AS sign) s,
LATERAL (SELECT CASE WHEN sign = 1 THEN event_id ELSE following END AS applied) a
WHERE applied IS NOT NULL
"""


@query(LOG_SQL)
def changelog(spark, sf):
    log = st.changelog(events(spark, sf), EVENTS, event_day())
    return log.select("*", F.col("applied_seq.event_id").alias("applied")).drop("applied_seq")


@query(f"""
SELECT DAY, event_type, {total('value')} FROM (
  SELECT DAY, event_type, value FROM ({NEWEST_SQL})
  UNION ALL SELECT DISTINCT DAY, event_type, 0.0 FROM ({EVENTS_SQL}))
GROUP BY ALL
""")
def changelog_cells(spark, sf):
    """Cells that fell back to zero stay."""
    spec = ViewSpec("day by type", rows=("event_type",), cols=("DAY",))
    cells = view_cells(st.ever_seen(events(spark, sf), EVENTS), EVENTS, spec, MONEY)
    return cells.drop("is_total", "hidden")


@query(f"""
SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS replaced,
       lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS replaced_ts
FROM events
""")
def previous_version(spark, sf):
    found = st.with_previous(events(spark, sf), EVENTS, event_day())
    return found.select(
        "user_id", "event_id", F.col("previous_seq.event_id").alias("replaced"),
        F.col("previous_seq.ts").alias("replaced_ts"),
    )


@query("""
SELECT COUNT(*) AS versions, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS elements,
       4 * COUNT(DISTINCT (l_orderkey, l_linenumber)) AS points
FROM lineitem
""")
def store_counts(spark, sf):
    return st.counts(lines(spark, sf), LINES)


@query(f"""
WITH newest AS ({NEWEST_SQL})
SELECT * FROM newest WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)
""")
def item_lookup(spark, sf):
    """The newest version of every user who once bought for more than 150."""
    buyers = table(spark, sf, "events").filter("event_type = 'purchase' AND value > 150").select("user_id")
    return st.lookup(events(spark, sf), EVENTS, buyers)


@query("""
SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus
                           ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
""")
def dedupe_points(spark, sf):
    names = ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    layout = Layout(key="l_orderkey", perimeter=("l_returnflag", "l_linestatus"), value="l_extendedprice")
    return el.deduplicated_rows(table(spark, sf, "lineitem").select(*names), layout, names[3:])


MIXED_SQL = """
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, p.pos AS pos, p.METRIC AS METRIC, p.BAND AS BAND, p.value AS value
  FROM (SELECT *, unnest([
          {'pos': 0, 'METRIC': l_returnflag, 'BAND': NULLIF(l_linestatus, 'O'), 'value': l_quantity},
          {'pos': 1, 'METRIC': 'A', 'BAND': 'F', 'value': l_extendedprice},
          {'pos': 2, 'METRIC': l_returnflag, 'BAND': NULL, 'value': 1.0},
          {'pos': 3, 'METRIC': 'N', 'BAND': NULL, 'value': 2.0}]) AS p
        FROM lineitem)
"""


def _mixed(spark, sf):
    """Line elements whose points may repeat a label tuple."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey",
        F.array(
            el.point(LINES, {"METRIC": F.col("l_returnflag"), "BAND": F.nullif("l_linestatus", F.lit("O"))}, F.col("l_quantity")),
            el.point(LINES, {"METRIC": "A", "BAND": "F"}, F.col("l_extendedprice")),
            el.point(LINES, {"METRIC": F.col("l_returnflag")}, F.lit(1.0)),
            el.point(LINES, {"METRIC": "N"}, F.lit(2.0)),
        ).alias("points"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate, l_partkey ORDER BY pos) - 1 AS pos,
       METRIC, BAND, value
FROM (SELECT * FROM ({MIXED_SQL})
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate, l_partkey, METRIC, BAND
                                 ORDER BY pos DESC) = 1)
""")
def dedupe_nested_points(spark, sf):
    """Per line, of points with equal labels the last one stays, in place."""
    return el.flatten(el.deduplicated(_mixed(spark, sf), LINES), LINES)


@query(f"""
SELECT METRIC, COALESCE(BAND, '-') AS BAND, {total('-value')} FROM ({LINES_SQL}) GROUP BY ALL
""")
def negated_copy(spark, sf):
    spec = ViewSpec("negated", rows=("BAND",), cols=("METRIC",))
    cells = view_cells(el.negated(lines(spark, sf), LINES), LINES, spec, MONEY)
    return cells.drop("is_total", "hidden")


@query(f"""
SELECT line_key || '-vol' AS line_key, l_shipdate, l_partkey, l_returnflag, 'DONE' AS l_linestatus, 'VOLUME' AS METRIC,
       BAND, value
FROM ({LINES_SQL}) WHERE METRIC = 'QTY'
""")
def filtered_clone(spark, sf):
    source = lines(spark, sf)
    picked = el.filtered_copy(source, LINES, "METRIC", "QTY", "VOLUME", F.concat("line_key", F.lit("-vol")))
    return el.copied(picked, LINES, core={"l_linestatus": F.lit("DONE")}).drop("pos")


@query(f"""
SELECT 2 AS size, line_key, l_shipdate, l_partkey, CAST(pos AS INT) AS pos, METRIC, {CENT.format('value')} AS value
FROM ({LINES_SQL}) WHERE pos < 2
UNION ALL
SELECT 5, line_key, l_shipdate, l_partkey, pos, METRIC, {CENT.format('value')} FROM ({LINES_SQL})
UNION ALL
SELECT 5, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), l_shipdate, l_partkey, 4, NULL, 0.0
FROM lineitem
""")
def resize_points(spark, sf):
    source = lines(spark, sf)

    def sized(n: int):
        rows = el.flatten(el.resized(source, LINES, n), LINES)
        return rows.select(F.lit(n).alias("size"), "line_key", "l_shipdate", "l_partkey", "pos", "METRIC", cents())

    return sized(2).unionByName(sized(5))


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, coalesce(list_position(
           ['QTY', 'PRICE', 'DISC', 'TAX'], CASE l_returnflag WHEN 'A' THEN 'QTY' WHEN 'N' THEN 'TAX' ELSE 'NONE' END), 0) - 1 AS found
FROM lineitem
""")
def find_index(spark, sf):
    """Position of the point a line asks for by its flag, -1 for a metric it does not have."""
    asked = F.when(F.col("l_returnflag") == "A", "QTY").when(F.col("l_returnflag") == "N", "TAX").otherwise("NONE")
    keyed = lines(spark, sf).withColumn("target", el.point(LINES, {"METRIC": asked}, F.lit(0.0)))
    parts = F.split("line_key", "-")
    return keyed.select(
        parts[0].cast("bigint").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), "l_shipdate", "l_partkey",
        el.index_of(LINES, F.col("points"), F.col("target"), ["METRIC"]).alias("found"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
FROM lineitem
""")
def point_positions(spark, sf):
    """Positions of the lines of an order, counted per range of lines first so that no order is one task's work."""
    source = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    chunk = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 10_000))
    return numbered(source, ["l_orderkey"], order, chunk, "pos")


FIRST_LAST_SQL = f"""
  first AS (SELECT * FROM ({PAIRS_SQL}) QUALIFY rank() OVER (PARTITION BY pair_key ORDER BY ts, event_id) = 1),
  last AS (SELECT * FROM ({PAIRS_SQL}) QUALIFY rank() OVER (PARTITION BY pair_key ORDER BY ts DESC, event_id DESC) = 1)
"""


def _first_last(spark, sf):
    """The first and the newest version per pair, found in one pass and kept, as both are read more than once."""
    source = pairs(spark, sf)
    rest = [c for c in source.columns if c != "pair_key"]
    seq = F.struct("ts", "event_id")
    both = checkpointed(source.groupBy("pair_key").agg(
        F.min_by(F.struct(*rest), seq).alias("first"), F.max_by(F.struct(*rest), seq).alias("last")
    ))
    return both.select("pair_key", "first.*"), both.select("pair_key", "last.*")


@query(f"""
WITH {FIRST_LAST_SQL}
SELECT l.pair_key, l.pos, l.METRIC, l.SIZE, {CENT.format('l.value')} - {CENT.format('f.value')} AS value
FROM last l JOIN first f ON l.pair_key = f.pair_key AND l.pos = f.pos
""")
def positional_subtract(spark, sf):
    first, last = _first_last(spark, sf)
    rows = el.flatten(diff.subtract_positional(last, first, PAIRS), PAIRS)
    return rows.select("pair_key", "pos", "METRIC", "SIZE", "value")


@query(f"""
WITH {FIRST_LAST_SQL}
SELECT COALESCE(l.pair_key, f.pair_key) AS pair_key, COALESCE(l.event_type, f.event_type) AS event_type,
       COALESCE(l.METRIC, f.METRIC) AS METRIC, COALESCE(l.SIZE, f.SIZE) AS SIZE,
       CAST(CAST(COALESCE(l.value, 0) - COALESCE(f.value, 0) AS DECIMAL(18,2)) AS DOUBLE) AS value
FROM last l FULL JOIN first f ON l.pair_key = f.pair_key AND l.METRIC = f.METRIC AND l.SIZE IS NOT DISTINCT FROM f.SIZE
""")
def label_subtract(spark, sf):
    """Elements of different shape: the size of a value is a label, so the points of the two may not pair up."""
    first, last = _first_last(spark, sf)
    return diff.subtract_by_labels(last, first, PAIRS).select(
        "pair_key", "event_type", "METRIC", "SIZE", cents()
    )


BASELINE_VIEW = ViewSpec("moves", rows=("METRIC", "SIZE"), cols=("event_type",), totals=("event_type",),
                         transform="against baseline", transform_arg="1.0")


@query(f"""
WITH {FIRST_LAST_SQL},
newest AS (SELECT pair_key, event_type, METRIC, SIZE, value FROM last
           UNION ALL SELECT pair_key || '-SOD', event_type, METRIC, SIZE, value FROM first)
SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS event_type, METRIC, SIZE,
       GROUPING(event_type) = 1 AS is_total, {total('value')}
FROM (
  SELECT event_type, METRIC, COALESCE(SIZE, '-') AS SIZE, value FROM newest
  UNION ALL
  SELECT event_type, METRIC, COALESCE(SIZE, '-'), -value FROM newest
  WHERE pair_key LIKE '%-SOD' AND left(pair_key, length(pair_key) - 4) IN (SELECT pair_key FROM newest))
GROUP BY GROUPING SETS ((event_type, METRIC, SIZE), (METRIC, SIZE))
""")
def baseline_view(spark, sf):
    """A view whose elements are first replaced by their difference against the baseline."""
    first, last = _first_last(spark, sf)
    newest = last.unionByName(el.copied(first, PAIRS, key=F.concat("pair_key", F.lit("-SOD"))))
    return view_cells(newest, PAIRS, BASELINE_VIEW, MONEY).drop("hidden")


@query(f"""
WITH {FIRST_LAST_SQL},
newest AS (SELECT pair_key, event_type, METRIC, SIZE, value FROM last
           UNION ALL SELECT pair_key || '-SOD', event_type, METRIC, SIZE, value FROM first)
SELECT pair_key, event_type, METRIC, SIZE, {total('value')} FROM (
  SELECT * FROM newest
  UNION ALL
  SELECT left(pair_key, length(pair_key) - 4), event_type, METRIC, SIZE, -value FROM newest
  WHERE pair_key LIKE '%-SOD' AND left(pair_key, length(pair_key) - 4) IN (SELECT pair_key FROM newest))
GROUP BY ALL
""")
def baseline_diff(spark, sf):
    """The newest version of a pair against its first one, which is stored as the baseline of the pair."""
    first, last = _first_last(spark, sf)
    newest = last.unionByName(el.copied(first, PAIRS, key=F.concat("pair_key", F.lit("-SOD"))))
    rows = diff.against_baseline(newest, PAIRS, measure=CENTS)
    return rows.withColumn("value", F.col("value").cast("double"))


DRILL = ViewSpec(
    "drill",
    rows=("BAND", "Desk"),
    cols=("METRIC",),
    filters={"METRIC": ("QTY", "TAX"), "l_returnflag": ("R", "N")},
    renames={"BAND": {"1Y": "SHORT", "2Y": "SHORT"}},
)


@query(f"""
SELECT value, l_shipdate, l_partkey, line_key, l_returnflag, l_linestatus, METRIC, BAND
FROM ({LINES_SQL})
WHERE METRIC = 'QTY' AND BAND IN ('SHORT', '1Y', '2Y') AND l_returnflag IN ('R', 'N')
ORDER BY l_shipdate DESC, l_partkey DESC, line_key, pos LIMIT 50
""")
def drill_newest(spark, sf):
    """The fifty newest rows behind the cell (QTY, SHORT); the total of Desk asks nothing."""
    request = {"METRIC": ["QTY"], "BAND": ["SHORT"], "Desk": ["Total"]}
    return drill(lines(spark, sf), LINES, DRILL, request, 50)


@query(f"""
SELECT value, l_shipdate, l_partkey, line_key, l_returnflag, l_linestatus, METRIC, BAND
FROM ({LINES_SQL})
WHERE METRIC IN ('QTY', 'TAX') AND BAND IS NULL AND l_returnflag IN ('R', 'A')
ORDER BY l_shipdate DESC, l_partkey DESC, line_key, pos LIMIT 40
""")
def drill_text_request(spark, sf):
    """A request as text: a missing label, several values, a piece without a name."""
    request = "l_returnflag=R\tA\fBAND=-\fnothing\f=x"
    return drill_from(lines(spark, sf), LINES, {"drill": DRILL}, "drill", request, 40)


STATES = ViewSpec("states", rows=("event_type",), cols=("DAY",), totals=("event_type",))


def _states(spark, sf):
    """The same view at two points in time: after 20 days, and at the end."""
    source = events(spark, sf)
    before = st.latest(source.filter("DAY <= '2024-01-20'"), EVENTS)
    return view_cells(before, EVENTS, STATES, MONEY), view_cells(st.latest(source, EVENTS), EVENTS, STATES, MONEY)


def _state_sql(name: str, where: str) -> str:
    newest = f"""SELECT * FROM ({EVENTS_SQL}) {where}
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
    return f"""{name} AS (
    SELECT DAY, CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS event_type,
           GROUPING(event_type) = 1 AS is_total, {total('value')}
    FROM ({newest}) GROUP BY GROUPING SETS ((DAY, event_type), (DAY)))"""


STATES_SQL = _state_sql("before", "WHERE DAY <= '2024-01-20'") + ", " + _state_sql("after", "")


@query(f"""
WITH {STATES_SQL}
SELECT COALESCE(a.DAY, b.DAY) AS DAY, COALESCE(a.event_type, b.event_type) AS event_type,
       COALESCE(a.is_total, b.is_total) AS is_total, CASE WHEN a.DAY IS NULL THEN 'DEL' ELSE 'UPD' END AS command,
       b.value AS before, a.value AS value
FROM after a FULL JOIN before b ON a.DAY = b.DAY AND a.event_type = b.event_type AND a.is_total = b.is_total
WHERE a.DAY IS NULL OR (CASE WHEN a.is_total THEN abs(a.value - COALESCE(b.value, 0)) > 1e-8
                             ELSE b.DAY IS NULL OR a.value <> b.value END)
""")
def changed_cells(spark, sf):
    before, after = _states(spark, sf)
    return cell_changes(before, after, ["DAY", "event_type"])


@query(f"""
WITH {STATES_SQL}
SELECT 'states' AS "viewName", CASE WHEN a.DAY IS NULL THEN 'DEL' ELSE 'UPD' END AS command,
       COALESCE(a.event_type, b.event_type) AS row_key, COALESCE(a.DAY, b.DAY) AS col_key,
       format('{{:,}}', CAST(round_even(CAST(a.value AS DECIMAL(18,2)), 0) AS BIGINT)) AS value
FROM after a FULL JOIN before b ON a.DAY = b.DAY AND a.event_type = b.event_type
WHERE a.DAY IS NULL OR (CASE WHEN a.is_total THEN abs(a.value - COALESCE(b.value, 0)) > 1e-8
                             ELSE b.DAY IS NULL OR a.value <> b.value END)
""")
def change_messages(spark, sf):
    """Updates and deletes between two states as JSON records, read back into columns."""
    before, after = _states(spark, sf)
    changes = cell_changes(before, after, ["DAY", "event_type"])
    text = as_json(update_records(changes, STATES))
    schema = "viewName string, command string, rowKeys array<string>, colKeys array<string>, value string"
    back = text.select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select("viewName", "command", F.col("rowKeys")[0].alias("row_key"), F.col("colKeys")[0].alias("col_key"), "value")


@query(f"""
WITH {STATES_SQL}
SELECT DAY, event_type, is_total, value FROM after
""")
def snapshot_table(spark, sf):
    """All published cells of a view, written as a table and read back."""
    path = new_work_dir(spark, "snapshot")
    write_snapshot(view_cells(st.latest(events(spark, sf), EVENTS), EVENTS, STATES, MONEY), path)
    return spark.read.parquet(path).drop("hidden")


@query(f"""
WITH {STATES_SQL}
SELECT DISTINCT DAY, event_type FROM before b
WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.DAY = b.DAY AND a.event_type = b.event_type)
""")
def vanished_cells(spark, sf):
    before, after = _states(spark, sf)
    return vanished(before, after, ["DAY", "event_type"])


@query(f"""
WITH {STATES_SQL}
SELECT 'states' AS "viewName", 'DELC' AS command, DAY AS col_key
FROM (SELECT DISTINCT DAY FROM before WHERE DAY NOT IN (SELECT DAY FROM after))
""")
def vanished_columns(spark, sf):
    before, after = _states(spark, sf)
    records = vanished_axis_records(before, after, STATES, rows=False)
    return records.select("viewName", "command", F.concat_ws("\t", "colKeys").alias("col_key"))


HIDING = ViewSpec("hiding", rows=("event_type",), cols=("DAY",), totals=("event_type",), hide=("event_type",))


@query(f"""
WITH {STATES_SQL}
SELECT 'hiding' AS "viewName", CASE WHEN a.DAY IS NULL THEN 'DEL' ELSE 'UPD' END AS command,
       COALESCE(a.event_type, b.event_type) AS row_key, COALESCE(a.DAY, b.DAY) AS col_key,
       format('{{:,}}', CAST(round_even(CAST(a.value AS DECIMAL(18,2)), 0) AS BIGINT)) AS value
FROM (SELECT * FROM after WHERE is_total) a FULL JOIN (SELECT * FROM before WHERE is_total) b ON a.DAY = b.DAY
WHERE a.DAY IS NULL OR abs(a.value - COALESCE(b.value, 0)) > 1e-8
""")
def hidden_changes(spark, sf):
    """Change records of a view with a hidden label: its totals only."""
    source = events(spark, sf)
    before, after = (
        view_cells(st.latest(rows, EVENTS), EVENTS, HIDING, MONEY) for rows in (source.filter("DAY <= '2024-01-20'"), source)
    )
    records = update_records(cell_changes(before, after, ["DAY", "event_type"]), HIDING)
    return records.select("viewName", "command", F.col("rowKeys")[0].alias("row_key"), F.col("colKeys")[0].alias("col_key"), "value")


NAMED_TOTAL = ViewSpec("named", rows=("event_type",), cols=("DAY",), totals=("event_type",))


@query(f"""
WITH e AS (SELECT DAY, CASE event_type WHEN 'error' THEN 'Total' ELSE event_type END AS event_type, value FROM ({EVENTS_SQL})),
c AS (SELECT DAY, CASE WHEN GROUPING(event_type) = 1 THEN 'Total' ELSE event_type END AS event_type,
             GROUPING(event_type) AS level, SUM(CAST(value AS DECIMAL(18,2))) AS value
      FROM e GROUP BY GROUPING SETS ((DAY, event_type), (DAY)))
SELECT 'named' AS "viewName", 'UPD' AS command, event_type AS row_key, DAY AS col_key,
       format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) AS value
FROM c QUALIFY row_number() OVER (PARTITION BY DAY, event_type ORDER BY level DESC) = 1
""")
def stored_total_records(spark, sf):
    """A stored label that reads Total: the total's record takes its place."""
    source = events(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "error", "Total").otherwise(F.col("event_type")))
    records = update_records(view_cells(source, EVENTS, NAMED_TOTAL, MONEY), NAMED_TOTAL)
    return records.select("viewName", "command", F.col("rowKeys")[0].alias("row_key"), F.col("colKeys")[0].alias("col_key"), "value")


LONG = {str(n): f"Group {n % 7}" for n in range(150)}


@query(f"""
SELECT 'groups' AS view, '' AS col_key, 'Group ' || (c_nationkey % 7) AS row_key, {total('c_acctbal')} FROM customer GROUP BY ALL
UNION ALL
SELECT 'segments' AS view, c_mktsegment AS col_key, 'Group ' || (c_nationkey % 7) AS row_key, {total('c_acctbal')} FROM customer GROUP BY ALL
UNION ALL
SELECT 'plain' AS view, '' AS col_key, CAST(c_nationkey AS VARCHAR) AS row_key, {total('c_acctbal')} FROM customer GROUP BY ALL
""")
def multi_view_long_rename(spark, sf):
    """Several views with renames of 150 entries share one pass; only sums are renamed."""
    layout = Layout(key="c_custkey", seq=("c_custkey",), core=("c_nationkey", "c_mktsegment"), value="c_acctbal")
    specs = (
        ViewSpec("groups", rows=("c_nationkey",), renames={"c_nationkey": LONG}),
        ViewSpec("segments", rows=("c_nationkey",), cols=("c_mktsegment",), renames={"c_nationkey": LONG}),
        ViewSpec("plain", rows=("c_nationkey",)),
    )
    cells = all_views(table(spark, sf, "customer"), layout, specs, MONEY)
    return cells.select("view", F.col("col_keys")[0].alias("col_key"), F.col("row_keys")[0].alias("row_key"), "value")


@query(f"""
SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN ts END AS ts, event_type, value, 1 AS points FROM ({NEWEST_SQL})
""")
def missing_seq(spark, sf):
    """Keys whose only version has no order keep what it holds, and their points count."""
    newest = st.latest(events(spark, sf), EVENTS).withColumn("ts", F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    single = EVENTS.with_(seq=("ts",))
    stored = st.counts(newest, single).select((F.col("points") / F.col("elements")).cast("int").alias("points"))
    return st.latest(newest, single).select("user_id", "ts", "event_type", "value").join(stored, F.lit(True))


TIES = ViewSpec("ties", rows=("KIND",), cols=("DAY",), totals=("KIND", "DAY"))

TIES_SQL = f"""
  SELECT CASE WHEN GROUPING(D) = 1 THEN 'Total' ELSE D END AS day_label, CASE WHEN GROUPING(K) = 1 THEN 'Total' ELSE K END AS kind_label,
         GROUPING(D) + GROUPING(K) AS level, {total('value')}
  FROM (SELECT CASE WHEN day(ts) = 1 THEN 'Total' ELSE DAY END AS D, CASE WHEN event_type = 'click' THEN 'Total' ELSE event_type END AS K, value FROM ({EVENTS_SQL}))
  GROUP BY GROUPING SETS ((D, K), (D), (K), ())
  QUALIFY row_number() OVER (PARTITION BY day_label, kind_label ORDER BY level DESC) = 1
"""


@query(f"""
SELECT 'record' AS source, day_label AS "DAY", kind_label AS "KIND", format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) AS value FROM ({TIES_SQL})
UNION ALL SELECT 'change', day_label, kind_label, format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) FROM ({TIES_SQL}) WHERE value > 1e-8
UNION ALL SELECT 'grid', day_label, kind_label, format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) FROM ({TIES_SQL})
""")
def total_ties(spark, sf):
    """Stored labels that read ``Total`` on both sides: of everything that reads the same, the widest total is shown."""
    named = EVENTS.with_(core=("KIND", "DAY"))
    rows = events(spark, sf).select(
        F.when(F.col("event_type") == "click", "Total").otherwise(F.col("event_type")).alias("KIND"), F.when(F.dayofmonth("ts") == 1, "Total").otherwise(F.col("DAY")).alias("DAY"), "value"
    )
    cells = checkpointed(view_cells(rows, named, TIES, MONEY, levels=True))
    records = update_records(cells, TIES).select(F.lit("record").alias("source"), F.col("colKeys")[0].alias("DAY"), F.col("rowKeys")[0].alias("KIND"), "value")
    changes = update_records(cell_changes(cells.limit(0), cells, TIES.columns), TIES).select(F.lit("change").alias("source"), F.col("colKeys")[0].alias("DAY"), F.col("rowKeys")[0].alias("KIND"), "value")
    grid = wide(cells, TIES)
    across = [c for c in grid.columns if c != "KIND"]
    long = grid.select("KIND", F.explode(F.create_map(*[x for c in across for x in (F.lit(c), F.col(f"`{c}`"))])).alias("DAY", "value")).filter("value is not null")
    return records.unionByName(changes).unionByName(long.select(F.lit("grid").alias("source"), "DAY", "KIND", accounting(F.col("value")).alias("value")))


HOURS = EVENTS.with_(key="event_id", seq=("ts",), core=("event_type", "DAY", "HOUR"))
HOURS_SQL = f"SELECT *, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS HOUR FROM ({EVENTS_SQL})"
HOUR_VIEW = ViewSpec("hours", rows=("event_type",), cols=("DAY", "HOUR", "SITE"), filters={"event_type": ("click", "view", "purchase")},
                     renames={"event_type": {"click": "visit", "view": "visit"}})


def _hours(spark, sf):
    return events(spark, sf).withColumn("HOUR", F.lpad(F.hour("ts").cast("string"), 2, "0"))


@query(f"""
WITH e AS ({HOURS_SQL}), asked AS (
  SELECT 'a ' || DAY || ' ' || HOUR AS request_id, * FROM e WHERE event_type IN ('click', 'view', 'purchase')
  UNION ALL SELECT 'b ' || HOUR AS request_id, * FROM e WHERE event_type IN ('click', 'view')
  UNION ALL SELECT 'c ' || DAY AS request_id, * FROM e WHERE event_type IN ('click', 'view', 'error', 'visit'))
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id) AS INT) AS rank, value, ts, event_id, event_type, DAY, HOUR
FROM asked QUALIFY rank <= 3
""")
def drill_many(spark, sf):
    """Hundreds of cells drilled in one pass: by day and hour, by a renamed label, and by a list; made-up labels ask nothing, unknown ones match nothing."""
    rows = _hours(spark, sf)
    asked = [
        (F.concat_ws(" ", F.lit("a"), "d", "h"), F.concat(F.lit("DAY="), "d", F.lit("\fHOUR="), "h", F.lit("\fSITE=x"))),
        (F.concat_ws(" ", F.lit("b"), "h"), F.concat(F.lit("event_type=visit\fHOUR="), "h", F.lit("\fDAY=Total"))),
        (F.concat_ws(" ", F.lit("c"), "d"), F.concat(F.lit("nothing\fevent_type=x\fevent_type=error\tvisit\t\fDAY="), "d")),
        (F.concat_ws(" ", F.lit("none"), "d"), F.concat(F.lit("FLOOR=1\fDAY="), "d")),
    ]
    times = rows.select(F.col("DAY").alias("d"), F.col("HOUR").alias("h")).distinct()
    requests = times.select(F.inline(F.array(*[F.struct(i.alias("request_id"), r.alias("request")) for i, r in asked]))).distinct().withColumn("view", F.lit("hours"))
    return dr.drill_many(rows, HOURS, {"hours": HOUR_VIEW}, requests, 3)
