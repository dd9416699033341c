"""View definitions as text: lines ``VIEW.ITEM=VALUE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import ViewSpec

# Fixed values of the format: the items, the line that ends a file early, and the shape of a line.
ITEMS = ("COL", "ROW", "HIDE", "TOTAL", "DESC", "CLASS", "CLASS_ARG", "FILTER", "SET")
END_LINE = "END"
LINE = r"^([^.]+)\.([^=]+)=(.*)$"


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Definition lines as ``view, item, val, file, block, line``, in file order.

    Blank lines and lines starting with ``#`` are skipped, reading stops at a line ``END``, and any other line that
    does not fit fails the query. Works line by line, so files of any size are split among tasks.
    """
    lines = spark.read.text(path).select(
        F.btrim(F.col("value"), F.lit(" \t\r")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    at = F.struct("block", "line")
    ends = lines.filter(F.col("text") == END_LINE).groupBy("file").agg(F.min(at).alias("_end"))
    lines = lines.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    lines = lines.join(ends, "file", "left").filter(F.col("_end").isNull() | (at < F.col("_end"))).drop("_end")
    item = F.upper(F.regexp_extract("text", LINE, 2))
    value = F.regexp_extract("text", LINE, 3)
    parts = F.size(F.split(F.regexp_replace(value, "=+$", ""), "="))
    fits = (
        F.col("text").rlike(LINE)
        & item.isin(*ITEMS)
        & ~((item == "FILTER") & (parts < 2))
        & ~((item == "SET") & (parts < 3))
    )
    checked = F.when(fits, F.regexp_extract("text", LINE, 1)).otherwise(
        F.raise_error(F.concat(F.lit("not a view definition: "), F.col("text")))
    )
    return lines.select(checked.alias("view"), item.alias("item"), value.alias("val"), "file", "block", "line")


def _ordered(items: DataFrame, item: str):
    """The values of one item in file order, as an array."""
    entries = F.collect_list(F.when(F.col("item") == item, F.struct("file", "block", "line", "val")))
    return F.transform(F.sort_array(entries), lambda e: e["val"])


def view_headers(items: DataFrame) -> DataFrame:
    """``view, row_labels, col_labels, description``; each list is cut at its first hidden attribute."""
    items = items.filter(F.col("item").isin("ROW", "COL", "HIDE", "DESC"))
    gathered = items.groupBy("view").agg(
        _ordered(items, "ROW").alias("rows"),
        _ordered(items, "COL").alias("cols"),
        F.collect_set(F.when(F.col("item") == "HIDE", F.col("val"))).alias("hide"),
        F.max_by("val", F.when(F.col("item") == "DESC", F.struct("file", "block", "line"))).alias("description"),
    )

    def until_hidden(labels: str):
        hidden_at = F.transform(labels, lambda n: F.array_contains("hide", n))
        first = F.array_position(hidden_at, True)
        cut = F.when(first > 0, F.slice(labels, F.lit(1), (first - 1).cast("int"))).otherwise(F.col(labels))
        return F.when((F.size(labels) == 0), F.array(F.lit(""))).otherwise(cut)

    return gathered.select(
        "view",
        until_hidden("rows").alias("row_labels"),
        until_hidden("cols").alias("col_labels"),
        F.coalesce("description", "view").alias("description"),
    )


def view_names(items: DataFrame) -> DataFrame:
    """Names of the views, ascending."""
    return items.select("view").distinct().orderBy("view")


def load_views(spark: SparkSession, path: str) -> dict[str, ViewSpec]:
    """The definitions as :class:`ViewSpec` values, for use in the library.

    The definitions that a program opens are configuration and fit its memory; catalogues of any size stay
    DataFrames, see :func:`read_definitions`.
    """
    found: dict[str, dict] = {}
    for r in read_definitions(spark, path).orderBy("file", "block", "line").toLocalIterator():
        parts = found.setdefault(
            r.view, {"rows": [], "cols": [], "totals": [], "hide": [], "filters": {}, "renames": {}}
        )
        if r.item in ("ROW", "COL", "TOTAL", "HIDE"):
            parts[{"ROW": "rows", "COL": "cols", "TOTAL": "totals", "HIDE": "hide"}[r.item]].append(r.val)
        elif r.item == "FILTER":
            name, accepted = r.val.split("=")[:2]
            parts["filters"].setdefault(name, []).append(accepted)
        elif r.item == "SET":
            name, old, new = r.val.split("=")[:3]
            parts["renames"].setdefault(name, {})[old] = new
        else:
            parts[{"DESC": "description", "CLASS": "transform", "CLASS_ARG": "transform_arg"}[r.item]] = r.val
    return {
        name: ViewSpec(
            name,
            **{
                k: tuple(v) if isinstance(v, list) else v
                for k, v in {**parts, "filters": {n: tuple(a) for n, a in parts["filters"].items()}}.items()
            },
        )
        for name, parts in found.items()
    }
