"""The driver tables read as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.model import Layout
from tallygrid.operators.elements import point

# Money and quantities have two decimals; they are summed exactly.
MONEY = "fixed(2)"
CENTS = "decimal(18,2)"


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the files once and then given, which saves a job per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# One element per order line, four points each. BAND is a tenor-like label that only QTY has.
LINES = Layout(
    key="line_key",
    seq=("l_shipdate", "l_partkey"),
    core=("l_returnflag", "l_linestatus"),
    perimeter=("METRIC", "BAND"),
)

LINES_SQL = """
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_key, l_shipdate, l_partkey,
         l_returnflag, l_linestatus, p.pos AS pos, p.METRIC AS METRIC, p.BAND AS BAND, p.value AS value
  FROM (SELECT *, unnest([
          {'pos': 0, 'METRIC': 'QTY', 'BAND': CAST(CAST(ceil(l_quantity / 10) AS INT) AS VARCHAR) || 'Y', 'value': l_quantity},
          {'pos': 1, 'METRIC': 'PRICE', 'BAND': NULL, 'value': l_extendedprice},
          {'pos': 2, 'METRIC': 'DISC', 'BAND': NULL, 'value': l_discount},
          {'pos': 3, 'METRIC': 'TAX', 'BAND': NULL, 'value': l_tax}]) AS p
        FROM lineitem)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    band = F.concat(F.ceil(F.col("l_quantity") / 10).cast("string"), F.lit("Y"))
    points = F.array(
        point(LINES, {"METRIC": "QTY", "BAND": band}, F.col("l_quantity")),
        point(LINES, {"METRIC": "PRICE"}, F.col("l_extendedprice")),
        point(LINES, {"METRIC": "DISC"}, F.col("l_discount")),
        point(LINES, {"METRIC": "TAX"}, F.col("l_tax")),
    )
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"),
        "l_shipdate",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        points.alias("points"),
    )


# Order lines as flat value rows, labelled by their order.
ORDER_LINES = Layout(
    key="o_orderkey",
    seq=("o_orderdate",),
    core=("o_orderpriority", "o_orderstatus"),
    perimeter=("l_returnflag", "l_linestatus"),
    value="l_extendedprice",
)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


# Order lines with the labels of the line itself.
FLAGS = Layout(
    key="l_orderkey",
    seq=("l_shipdate", "l_partkey"),
    core=("l_returnflag", "l_linestatus", "SHIP_YEAR"),
    value="l_extendedprice",
)


def flagged_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_partkey", "l_returnflag", "l_linestatus",
        F.year("l_shipdate").cast("string").alias("SHIP_YEAR"), "l_extendedprice",
    )


FLAGS_SQL = "SELECT *, strftime(l_shipdate, '%Y') AS SHIP_YEAR FROM lineitem"

# Orders as single-point elements; STATUS lacks a label where the status is P.
ORDERS = Layout(
    key="o_orderkey",
    seq=("o_orderdate",),
    core=("o_orderpriority", "o_orderstatus", "STATUS"),
    value="o_totalprice",
)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("STATUS", F.nullif("o_orderstatus", F.lit("P")))


# Events as versions of a user: every event replaces the one before it.
EVENTS = Layout(
    key="user_id",
    seq=("ts", "event_id"),
    core=("event_type", "DAY"),
    value="value",
)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id", "event_type", F.to_date("ts").cast("string").alias("DAY"), "value"
    )


EVENTS_SQL = "SELECT user_id, ts, event_id, event_type, strftime(ts, '%Y-%m-%d') AS DAY, value FROM events"


def event_day():
    """Rises with the order of events; splits the history of a user into days."""
    return F.date_trunc("day", "ts")


# Events as versions of a (user, type) pair, two points each.
PAIRS = Layout(
    key="pair_key",
    seq=("ts", "event_id"),
    core=("event_type",),
    perimeter=("METRIC", "SIZE"),
)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    size = F.when(value < 10, F.lit("LOW")).when(value < 50, F.lit("MID"))
    return table(spark, sf, "events").select(
        F.concat_ws("-", "user_id", "event_type").alias("pair_key"), "ts", "event_id", "event_type",
        F.array(
            point(PAIRS, {"METRIC": "VALUE", "SIZE": size}, value),
            point(PAIRS, {"METRIC": "HOUR"}, F.hour("ts")),
        ).alias("points"),
    )


PAIRS_SQL = """
  SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS pair_key, ts, event_id, event_type, p.pos AS pos,
         p.METRIC AS METRIC, p.SIZE AS SIZE, p.value AS value
  FROM (SELECT *, unnest([
          {'pos': 0, 'METRIC': 'VALUE', 'SIZE': CASE WHEN value < 10 THEN 'LOW' WHEN value < 50 THEN 'MID' END, 'value': value},
          {'pos': 1, 'METRIC': 'HOUR', 'SIZE': NULL, 'value': CAST(hour(ts) AS DOUBLE)}]) AS p
        FROM events)
"""


def total(column: str, alias: str = "value") -> str:
    """The exact sum of a two-decimal column in the SQL of the checks."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) AS {alias}"
