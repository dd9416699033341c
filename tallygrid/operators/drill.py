"""From a cell back to the newest value rows behind it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import AXIS_SEPARATOR, LABEL_SEPARATOR, NULL_LABEL, TOTAL_LABEL, one_of, raw
from ..model import Layout
from ..plans.spec import ViewSpec
from ..session import checkpointed
from .elements import flatten

Request = Mapping[str, Sequence[str]]


def parse_request(text: str) -> dict[str, list[str]]:
    """``ATTR=V1<tab>V2<formfeed>ATTR2=V3`` as a dict; pieces without a name are skipped, the last of a name wins."""
    request: dict[str, list[str]] = {}
    for piece in text.split(AXIS_SEPARATOR):
        name, equals, listed = piece.partition("=")
        if not equals or not name or listed == TOTAL_LABEL:
            continue
        values = listed.rstrip(LABEL_SEPARATOR).split(LABEL_SEPARATOR)
        request[name] = values
    return request


def request_tests(layout: Layout, spec: ViewSpec, request: Request) -> dict[str, list[str]]:
    """What each attribute must equal one of, after taking the view into account.

    A total asks nothing of its attribute. Filters of the view apply to attributes the request leaves open. A
    renamed label also admits the labels it stands for. Labels of the view that no element has are ignored.
    """
    tests = {n: list(v) for n, v in request.items() if list(v) != [TOTAL_LABEL]}
    for name, accepted in spec.filters.items():
        tests.setdefault(name, list(accepted))
    for name, mapping in spec.renames.items():
        if name in tests:
            shown = set(tests[name])
            tests[name] += [old for old, new in mapping.items() if new in shown and old not in shown]
    made_up = {a.attribute for a in spec.axes if a.attribute not in layout.attributes}
    return {n: v for n, v in tests.items() if n not in made_up}


def request_filter(layout: Layout, tests: Request, compat: bool = False) -> Column:
    """All tests as one condition. An attribute that no element has matches nothing.

    With ``compat`` a missing core label matches no value at all, not even ``-``.
    """
    conditions = []
    for name, accepted in tests.items():
        if name not in layout.attributes:
            conditions.append(F.lit(False))
        elif compat and name in layout.core:
            conditions.append(raw(name).isin(list(accepted)))
        else:
            conditions.append(one_of(layout, name, accepted))
    return reduce(and_, conditions) if conditions else F.lit(True)


def drill(newest: DataFrame, layout: Layout, spec: ViewSpec, request: Request | str, limit: int,
          created: str | None = None, compat: bool = False) -> DataFrame:
    """The newest ``limit`` value rows behind a cell, with their stored labels.

    Ties are broken by key and position. The limit is the caller's report size; each task keeps only that many rows.
    """
    asked = parse_request(request) if isinstance(request, str) else request
    tests = request_tests(layout, spec, asked)
    rows = newest
    if layout.is_nested(newest):
        rows = newest.filter(request_filter(layout, {n: v for n, v in tests.items() if n in layout.core}, compat))
        rows = flatten(rows, layout)
    rows = rows.filter(request_filter(layout, tests, compat))
    newest_first = [F.col(f"`{c}`").desc() for c in ([created] if created else layout.seq)]
    tie_break = [F.col(f"`{layout.key}`")] + ([F.col(layout.pos)] if layout.pos in rows.columns else [])
    shown = [layout.value, *([created] if created else layout.seq), layout.key, *layout.attributes]
    return rows.orderBy(*newest_first, *tie_break).limit(limit).select(*[F.col(f"`{c}`") for c in shown])


def drill_from(newest: DataFrame, layout: Layout, specs: Mapping[str, ViewSpec], view: str, request: Request | str,
               limit: int, **options) -> DataFrame:
    """:func:`drill` by view name."""
    if view not in specs:
        raise ValueError(f"no view named {view}")
    return drill(newest, layout, specs[view], request, limit, **options)


def parsed_requests(requests: DataFrame, request_id: str = "request_id", view: str = "view", text: str = "request") -> DataFrame:
    """A table of request texts as one row per accepted value: ``request_id, view, attribute, value``.

    The rules are those of :func:`parse_request`. A request that asks nothing has no row.
    """
    asked = requests.select(F.col(f"`{request_id}`").alias("request_id"), F.col(f"`{view}`").alias("view"), F.posexplode(F.split(F.col(f"`{text}`"), AXIS_SEPARATOR)).alias("at", "piece"))
    equals = F.instr("piece", "=")
    named = asked.filter(equals > 1).select("request_id", "view", "at", F.substring("piece", F.lit(1), equals - 1).alias("attribute"), F.substring("piece", equals + 1, F.length("piece")).alias("listed"))
    last = named.filter(F.col("listed") != TOTAL_LABEL).groupBy("request_id", "view", "attribute").agg(F.max_by("listed", "at").alias("listed"))
    values = F.split(F.regexp_replace("listed", f"{LABEL_SEPARATOR}+$", ""), LABEL_SEPARATOR)
    return last.select("request_id", "view", "attribute", F.explode(F.array_distinct(values)).alias("value"))


def _definitions(spark: SparkSession, layout: Layout, specs: Mapping[str, ViewSpec]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filters, renames and made-up labels of all views, as tables."""
    filters = [(v, n, x) for v, s in specs.items() for n, accepted in s.filters.items() for x in dict.fromkeys(accepted)]
    renames = [(v, n, new, old) for v, s in specs.items() for n, mapping in s.renames.items() for old, new in mapping.items()]
    made_up = {(v, a.attribute) for v, s in specs.items() for a in s.axes if a.attribute not in layout.attributes}
    return (
        spark.createDataFrame(filters, "view string, attribute string, value string"),
        spark.createDataFrame(renames, "view string, attribute string, value string, stored string"),
        spark.createDataFrame(sorted(made_up), "view string, attribute string"),
    )


def requested_values(requests: DataFrame, layout: Layout, specs: Mapping[str, ViewSpec]) -> DataFrame:
    """What each request accepts per attribute once its view is taken into account, by the rules of :func:`request_tests`.

    ``requests`` has ``request_id, view, request``. A view without a name in ``specs`` is an error. The result has ``request_id, attribute, value``.
    """
    spark = requests.sparkSession
    known = F.col("view").isin(list(specs))
    checked = requests.withColumn("view", F.when(known, F.col("view")).otherwise(F.raise_error(F.concat(F.lit("no view named "), F.coalesce("view", F.lit("null"))))))
    filters, renames, made_up = _definitions(spark, layout, specs)
    asked = parsed_requests(checked)
    own = asked.select("request_id", "attribute").distinct()
    filtered = checked.select("request_id", "view").join(filters, "view").join(own, ["request_id", "attribute"], "left_anti")
    values = asked.unionByName(filtered)
    stored = values.join(renames, ["view", "attribute", "value"]).select("request_id", "view", "attribute", F.col("stored").alias("value"))
    return values.unionByName(stored).join(made_up, ["view", "attribute"], "left_anti").select("request_id", "attribute", "value").distinct()


def drill_many(newest: DataFrame, layout: Layout, specs: Mapping[str, ViewSpec], requests: DataFrame, limit: int, created: str | None = None) -> DataFrame:
    """The newest ``limit`` value rows behind each of many cells, in one pass: ``request_id, rank`` (from 1) and what :func:`drill` shows.

    ``requests`` has ``request_id, view, request`` (text); repeated ids are one request. Rows are first cut to the newest ``limit`` of each set of labels that the requests look at, which
    a task does before the shuffle. The sets, few against the rows, are divided by the requests: a set belongs to a
    request if it holds an accepted value for each of its attributes. Requests for nothing in particular share the newest rows of all.
    """
    tests = checkpointed(requested_values(requests, layout, specs))
    names = sorted(r[0] for r in tests.select("attribute").distinct().join(
        newest.sparkSession.createDataFrame([(n,) for n in layout.attributes], "attribute string"), "attribute", "left_semi").collect())
    rows = flatten(newest, layout)
    times = [created] if created else list(layout.seq)
    ties = [F.col(f"`{layout.key}`")] + ([F.col(layout.pos)] if layout.pos in rows.columns else [])
    newest_first = [*[F.col(f"`{c}`").desc() for c in times], *ties]
    labels = [F.coalesce(raw(n), F.lit(NULL_LABEL)) for n in names]
    marked = rows.withColumn("_labels", F.array(*labels).cast("array<string>"))
    cut = marked.withColumn("_place", F.row_number().over(Window.partitionBy("_labels").orderBy(*newest_first))).filter(F.col("_place") <= limit).drop("_place")
    cut = checkpointed(cut)
    sets = cut.select("_labels").distinct()
    held = sets.select("_labels", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("attribute"), F.col("_labels").alias("value"))).alias("_held")).select("_labels", "_held.*")
    wanted = tests.groupBy("request_id").agg(F.countDistinct("attribute").alias("wanted"))
    met = held.join(tests, ["attribute", "value"]).groupBy("request_id", "_labels").agg(F.count(F.lit(1)).alias("met"))
    matched = met.join(wanted, "request_id").filter("met = wanted").select("request_id", "_labels")
    ranked = cut.join(matched, "_labels").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*newest_first))).filter(F.col("rank") <= limit)
    shown = ["request_id", "rank", *[F.col(f"`{c}`") for c in (layout.value, *times, layout.key, *layout.attributes)]]
    open_ = requests.select("request_id").distinct().join(wanted, "request_id", "left_anti").select("request_id", F.explode(F.sequence(F.lit(1), F.lit(max(limit, 1)))).alias("rank"))
    first = rows.orderBy(*newest_first).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*newest_first)))
    return ranked.select(*shown).unionByName(open_.join(first, "rank").select(*shown))
