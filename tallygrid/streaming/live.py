"""Many views on one stream of elements, published as change records from state.

One query does everything: elements become signed versions (state: the newest version per key), these become signed numbers per cell of every view, and a
second state holds per cell its sum and the number last published. A micro-batch reads what it brings and the state of the cells it touches, and nothing of earlier
ones, so a feed costs the same however old it is.

Records are published per micro-batch in folders of a feed. A position is the number of the last committed micro-batch; whoever attaches gets the
cells as of a position, and follows with the records after it.

A feed with epochs has batches that replace everything. While an epoch is open, nothing is published. Its closing marker releases it once: cells that are new
or different are updated, cells that it does not have are deleted. From then on its changes are published as they come, until the next epoch opens.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.labels import TOTAL_LABEL
from ..model import Layout
from ..operators.cells import _core_filter, attributes_read, axis_label, fixed_scale, measured, view_filter
from ..operators.changes import DELETE, TOTAL_CHANGE, UPDATE
from ..operators.difference import BASELINE_SUFFIX
from ..operators.elements import flatten
from ..plans.spec import ViewSpec, total_sets
from ..plans.view import BASELINE_TRANSFORM, baseline_factor, transformed
from ..session import by_value
from .cells import rate_interval
from .pages import Pages, entries
from .upsert import BASELINE, OWN, SETTINGS, _body_type, bodies, configured, signed_versions

by_value(__name__)

# Markers in the feed: they tell where the batch of an epoch begins and ends.
OPEN, CLOSE = "open", "close"

RECORDS = "view string, command string, is_total boolean, col_keys array<string>, row_keys array<string>, before double, value double"
_CELL = "view string, cols array<string>, rows array<string>"
_ADDED = "cell string, level int, epoch bigint, amount {kind}, marker string, bucket bigint"
_NO_EPOCH = -(1 << 63)


def _kind(measure: str) -> str:
    if measure == "double":
        return "double"
    if fixed_scale(measure) is None:
        raise ValueError(f"live sums take double or fixed(n), not {measure}")
    return "bigint"


#: How the keys of elements start that no transform has changed.
_PLAIN = "0:"


def _groups(specs: Sequence[ViewSpec]) -> dict[str, list[ViewSpec]]:
    """The views by transform, under what the keys of the transformed elements start with."""
    found: dict[str, list[ViewSpec]] = {}
    for spec in specs:
        own = _PLAIN if spec.transform in (None, BASELINE_TRANSFORM) else json.dumps([spec.transform, spec.transform_arg]) + ":"
        found.setdefault(own, []).append(spec)
    return found


def _variants(spec: ViewSpec, rule: str) -> list[tuple[int, ...]]:
    return [tuple(range(len(spec.axes))), *total_sets(spec, rule)]


def _entries(layout: Layout, spec: ViewSpec, rule: str) -> Column:
    """The cell of a value row in a view and the total cells above it, or null if the view does not take the row."""
    found = []
    for level, kept in enumerate(_variants(spec, rule)):
        labels = [axis_label(layout, spec, a) if i in kept else F.lit(TOTAL_LABEL) for i, a in enumerate(spec.axes)]
        sides = [F.array(*[x for x, a in zip(labels, spec.axes) if a.is_column is side]) for side in (True, False)]
        cell = F.to_json(F.struct(F.lit(spec.name).alias("view"), sides[0].alias("cols"), sides[1].alias("rows")))
        found.append(F.struct(cell.alias("cell"), F.lit(level).alias("level")))
    factor = F.lit(1.0) if spec.transform != BASELINE_TRANSFORM else F.lit(-baseline_factor(spec))
    roles = F.col("role") == OWN if spec.transform != BASELINE_TRANSFORM else F.lit(True)
    entry = F.struct(F.array(*found).alias("cells"), F.when(F.col("role") == BASELINE, factor).otherwise(F.lit(1.0)).alias("factor"))
    return F.when(view_filter(layout, spec) & roles, entry)


def cell_rows(versions: DataFrame, body_type: T.StructType, layout: Layout, groups: dict[str, list[ViewSpec]], measure: str, rule: str) -> DataFrame:
    """Signed versions as signed numbers of cells: ``cell``, ``level``, ``epoch``, ``amount``. All views are served by one pass."""
    specs = [s for own in groups.values() for s in own]
    opened = bodies(versions.select("key", "epoch", "sign", "role", "body"), body_type).select("key", "epoch", "sign", "role", "_body.*")
    if layout.is_nested(opened):
        opened = opened.filter(reduce(or_, [_core_filter(layout, s) for s in specs]))
    rows = flatten(opened, layout, attributes_read(specs))
    entries = F.array(*[F.when(F.col("key").startswith(start), _entries(layout, s, rule)) for start, own in groups.items() for s in own])
    spread = rows.select("epoch", "sign", F.col(layout.value), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_entry"))
    # What has entered and left adds nothing, be it infinite, and touches its cells.
    value = F.col(layout.value).cast("double") * F.col("_entry.factor") * F.col("sign")
    value = F.when(F.col("sign") != 0, value).when(F.col(layout.value).cast("double").isNotNull(), 0.0)
    amount = measured(Layout(value="_value"), measure).alias("amount")
    return spread.withColumn("_value", value).select("epoch", amount, F.inline("_entry.cells")).filter("amount is not null")


def _summed_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch of rows one row per cell, level and epoch; markers pass."""
    for rows in batches:
        marked = rows["marker"].notna()
        if marked.any():
            yield rows[marked]
            rows = rows[~marked]
        sums = rows.groupby(["cell", "level", "epoch", "bucket"], sort=False, as_index=False)["amount"].sum()
        yield sums.assign(marker=None)[["cell", "level", "epoch", "amount", "marker", "bucket"]]


class _LiveCells(StatefulProcessor):
    """Sums and last published numbers of cells, in pages per bucket of cells.

    ``current`` has the cells of the epoch that is published, ``open`` the sums of epochs that are not closed yet, ``marks`` the number
    of the published epoch and whether a later one is open. A cell may be summed at several levels that read the same (a total
    and a stored label ``Total``); the widest total is the one that is published.
    """

    def __init__(self, width: dict[str, list[int]], hidden: list[str], scale: int | None, epochs: bool) -> None:
        self._width, self._hidden, self._scale, self._epochs = width, frozenset(hidden), scale, epochs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._current = Pages(handle, "current")
        self._open = Pages(handle, "open") if self._epochs else None
        self._marks = handle.getValueState("marks", "published bigint, opened bigint")

    def _unpacked(self, state: list | None) -> dict[int, float]:
        return {} if state is None else dict(zip(*state[:2]))

    def _packed(self, held: dict[int, float]) -> tuple:
        return list(held), list(held.values())

    def _record(self, cell: str, held: dict[int, float], shown: float | None, touched: bool) -> tuple[tuple | None, float | None]:
        """The record that tells the state of a cell, if one is due, and the number published after it."""
        parsed = json.loads(cell)
        width = self._width[parsed["view"]]
        levels = [n for n in held if n or parsed["view"] not in self._hidden]
        if not levels:
            if shown is None:
                return None, None
            return (parsed["view"], DELETE, False, parsed["cols"], parsed["rows"], shown, None), None
        level = max(levels, key=lambda n: (width[n], n))
        value = held[level] if self._scale is None else held[level] / 10**self._scale
        if level:
            due = abs(value - (shown or 0.0)) > TOTAL_CHANGE
        else:
            due = touched or shown is None or value != shown
        if not due:
            return None, shown
        return (parsed["view"], UPDATE, level > 0, parsed["cols"], parsed["rows"], shown, value), value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[tuple[int, str], dict[int, float]] = {}
        markers: list[tuple[int, str]] = []
        for batch in rows:
            for cell, level, epoch, amount, marker in zip(*[batch[c].tolist() for c in ("cell", "level", "epoch", "amount", "marker")]):
                if marker is not None:
                    markers.append((int(epoch), marker))
                    continue
                own = added.setdefault((int(epoch), cell), {})
                own[int(level)] = own.get(int(level), 0) + amount
        self._current.open()
        if self._epochs:
            self._open.open()
        published, opened = self._marks.get() if self._marks.exists() else (_NO_EPOCH if self._epochs else 0, _NO_EPOCH)
        records = []
        opened = max([opened, *[e for e, m in markers if m == OPEN], *[e for e, _ in added if e > published]]) if self._epochs else opened
        for (epoch, cell), more in added.items():
            if epoch < published:
                continue
            live = epoch == published
            state = self._current.get(cell) if live else self._open.get(f"{epoch}:{cell}")
            held = self._unpacked(state)
            for level, amount in more.items():
                held[level] = held.get(level, 0) + amount
            if not live:
                self._open.put(f"{epoch}:{cell}", self._packed(held))
                continue
            shown = state[2] if state is not None else None
            if opened <= published:
                record, shown = self._record(cell, held, shown, True)
                if record is not None:
                    records.append(record)
            self._current.put(cell, (*self._packed(held), shown))
        for epoch in sorted({e for e, m in markers if m == CLOSE and e > published}):
            records += self._closed(epoch)
            published = epoch
        if self._epochs:
            self._marks.update((published, opened))
            self._open.save()
        self._current.save()
        yield pd.DataFrame(records, columns=[c.split()[0] for c in RECORDS.split(", ")])

    def _closed(self, epoch: int) -> list[tuple]:
        """Replace the published cells by those of an epoch."""
        records, new = [], {}
        for key, sums in self._open.items():
            own, cell = key.split(":", 1)
            if int(own) <= epoch:
                if int(own) == epoch:
                    new[cell] = self._unpacked(sums)
                self._open.remove(key)
        before = {cell: state[2] for cell, state in self._current.items()}
        for cell, shown in before.items():
            if cell not in new:
                self._current.remove(cell)
                if shown is not None:
                    parsed = json.loads(cell)
                    records.append((parsed["view"], DELETE, False, parsed["cols"], parsed["rows"], shown, None))
        for cell, held in new.items():
            record, shown = self._record(cell, held, before.get(cell), False)
            if record is not None:
                records.append(record)
            self._current.put(cell, (*self._packed(held), shown))
        return records

    def close(self) -> None:
        pass


def live_records(elements: DataFrame, layout: Layout, specs: Sequence[ViewSpec], measure: str = "double", rule: str = "documented", epoch: str | None = None,
                 marker: str | None = None, fills: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """The change records of all views over a stream of element versions: ``view, command, is_total, col_keys, row_keys, before, value``.

    Per micro-batch, a visible base cell that a row has touched is updated, and a total that moved by more than 1e-8. Hidden cells
    are never published. Cells that fall back to zero stay until an epoch without them closes.

    Transforms of views see single elements and must not combine rows. What a transform drops counts as an element without points. The
    difference against a baseline is kept in state: it follows whenever the element or its baseline changes, in nested and flat input alike.

    ``epoch`` names a whole-number column; ``marker`` a column that is null for elements and ``open`` or ``close`` in rows that only tell that an
    epoch's batch begins or ends. An epoch opens with its first row at the latest. Rows of an epoch after its closing are published as
    they come; a row of an epoch before the published one is dropped. Markers count after the other rows of their micro-batch.

    ``fills`` is a stream of sums to add (see :meth:`Feed.add_view`). ``buckets`` bounds how finely state is spread and stays the same for a checkpoint.
    """
    kind = _kind(measure)
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("two views of one name")
    data = elements if marker is None else elements.filter(F.col(f"`{marker}`").isNull())
    versions = _versions(data, layout, specs, epoch, buckets)
    rows = cell_rows(versions, _body_type(data, layout), layout, _groups(specs), measure, rule)
    rows = rows.select("cell", "level", "epoch", "amount", F.lit(None).cast("string").alias("marker"), F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket"))
    if marker is not None:
        marked = elements.filter(F.col(f"`{marker}`").isNotNull()).select(
            F.lit("").alias("cell"), F.lit(0).alias("level"), F.col(f"`{epoch}`").cast("bigint").alias("epoch"), F.lit(0).cast(kind).alias("amount"),
            F.col(f"`{marker}`").alias("marker"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"),
        )
        rows = rows.unionByName(marked)
    if fills is not None:
        rows = rows.unionByName(fills.select("cell", "level", "epoch", F.col("amount").cast(kind), F.lit(None).cast("string").alias("marker"), F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket")))
    width = {s.name: [len(s.axes) - len(kept) for kept in _variants(s, rule)] for s in specs}
    summed = rows.mapInPandas(_summed_per_batch, _ADDED.format(kind=kind))
    processor = _LiveCells(width, [s.name for s in specs if s.is_hidden], fixed_scale(measure), epoch is not None)
    return summed.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=RECORDS, outputMode="append", timeMode="none")


def _versions(data: DataFrame, layout: Layout, specs: Sequence[ViewSpec], epoch: str | None, buckets: int) -> DataFrame:
    """Signed versions of all elements, once per transform; their keys start as :func:`_groups` says."""
    groups = _groups(specs)
    paired = tuple(start for start, own in groups.items() if any(s.transform == BASELINE_TRANSFORM for s in own))
    suffix = BASELINE_SUFFIX if paired else ""
    parts = None
    for start, own in groups.items():
        plain = data.withColumn("_start", F.lit(start))
        if len(groups) > 1 or start != _PLAIN:
            plain = plain.withColumn("_empty", F.lit(False))
        if start != _PLAIN:
            # An element that the transform drops still replaces the version before it: it stays as an empty one.
            changed = transformed(plain, layout, own[0])
            if missing := set(plain.columns) - set(changed.columns):
                raise ValueError(f"transform {own[0].transform} loses the columns {sorted(missing)}")
            plain = plain.withColumn("_empty", F.lit(True)).unionByName(changed.select(*plain.columns))
        parts = plain if parts is None else parts.unionByName(plain)
    empty = F.col("_empty") if "_empty" in parts.columns else None
    return signed_versions(parts, layout, epoch, buckets, F.col("_start"), empty, suffix, paired, tuple(groups))


class Feed:
    """A folder with everything a live feed keeps: its records by micro-batch, compacted states, sums for added views, and the checkpoint."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self._spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], schema)

    def position(self) -> int:
        """The number of the last micro-batch that is published whole, -1 before the first one. The checkpoint's own commits tell."""
        try:
            names = self._spark.read.text(self._path("checkpoint/commits")).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        last = names.filter(F.col("name").rlike("^[0-9]+$")).agg(F.max(F.col("name").cast("bigint"))).first()[0]
        return -1 if last is None else last

    def fills(self, measure: str = "double") -> DataFrame:
        """The sums of added views, as a stream for :func:`live_records`."""
        schema = f"cell string, level int, epoch bigint, amount {_kind(measure)}"
        path = self._path("fills")
        if not self._exists(f"{path}/of=none"):
            self._spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/of=none")
        return self._spark.readStream.schema(f"{schema}, of string").parquet(path)

    def _exists(self, path: str) -> bool:
        try:
            self._spark.read.format("binaryFile").load(path).limit(0).count()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def start(self, records: DataFrame, rate: int | None = None, partitions: int | None = None) -> StreamingQuery | None:
        """Publish the records of every micro-batch. Without ``rate``, run over what is there and end; a rate of 0 starts nothing.

        A repeated micro-batch replaces its own folder. The rate may differ from start to start: stopping and starting changes it. ``partitions`` is
        the number of tasks that share the state, by default the session's shuffle partitions; the first start decides for the life of the feed.
        """
        if rate == 0:
            return None
        spark = self._spark
        target = self._path("records")

        def publish(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        writer = records.writeStream.outputMode("append").option("checkpointLocation", self._path("checkpoint")).foreachBatch(publish)
        writer = writer.trigger(availableNow=True) if rate is None else writer.trigger(processingTime=rate_interval(rate))
        with configured(spark, {**SETTINGS, **({SHUFFLE: str(partitions)} if partitions else {})}):
            return writer.start()

    def change_rate(self, query: StreamingQuery | None, records: DataFrame, rate: int) -> StreamingQuery | None:
        """Go on at another rate from where ``query`` is; a rate of 0 pauses."""
        if query is not None:
            query.stop()
            query.awaitTermination()
        return self.start(records, rate)

    def records(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """The published records with the number of their micro-batch as ``batch``."""
        upto = self.position() if upto is None else upto
        found = self._read(self._path("records"), f"{RECORDS}, batch bigint")
        return found.filter((F.col("batch") > after) & (F.col("batch") <= upto))

    def tail(self, after: int, max_files: int | None = None) -> DataFrame:
        """The records after a position, as a stream. A repeated micro-batch may tell the same again."""
        reader = self._spark.readStream.schema(f"{RECORDS}, batch bigint")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self._path("records")).filter(F.col("batch") > after)

    def _state(self) -> tuple[int, DataFrame]:
        """The newest compacted state and its position. A state counts only if its micro-batch is named in the list of states, which is written last."""
        listed = self._read(self._path("states/list"), "batch bigint").agg(F.max("batch")).first()[0]
        at = -1 if listed is None else listed
        return at, self._read(self._path(f"states/cells/batch={at}"), RECORDS.replace(", before double", ""))

    def _folded(self, state: tuple[int, DataFrame], upto: int) -> DataFrame:
        base = state[1].withColumn("batch", F.lit(state[0]).cast("bigint"))
        later = self.records(state[0], upto).drop("before")
        keys = ["view", "col_keys", "row_keys"]
        newest = F.max_by(F.struct("command", "is_total", "value"), "batch").alias("_newest")
        return base.unionByName(later).groupBy(*keys).agg(newest).select(*keys, "_newest.*").filter(F.col("command") == UPDATE)

    def compact(self) -> int:
        """Fold the records since the last call into a new state and return its position; nothing to do before the first micro-batch."""
        state, last = self._state(), self.position()
        if last > state[0]:
            columns = [c.split()[0] for c in RECORDS.split(", ") if not c.startswith("before")]
            self._folded(state, last).select(*columns).write.mode("overwrite").parquet(self._path(f"states/cells/batch={last}"))
            self._spark.createDataFrame([(last,)], "batch bigint").write.mode("append").parquet(self._path("states/list"))
        return last

    def attach(self) -> tuple[DataFrame, int]:
        """All visible cells (``view, col_keys, row_keys, is_total, value``) and the position they are of; :meth:`tail` goes on from there.

        Nothing is missed or told twice. Before the first micro-batch there are no cells and the position is -1.
        """
        at = self.position()
        return self._folded(self._state(), at).select("view", "col_keys", "row_keys", "is_total", "value"), at

    def add_view(self, spec: ViewSpec, elements: DataFrame, layout: Layout, specs: Sequence[ViewSpec], measure: str = "double", rule: str = "documented") -> int:
        """Fill a new view with the elements that the stopped feed holds, and return the position up to which it is filled.

        The newest versions are read from the state of the last committed micro-batch; their sums wait in the feed's fills, and what comes
        after that micro-batch reaches the view through the stream. So the feed has to be stopped before, and to be
        started after with ``specs`` and the new view, while no epoch is open. Views with a transform are filled by a feed of their own.
        """
        if spec.transform is not None:
            raise ValueError(f"view {spec.name}: only views without a transform can be added")
        at = self.position()
        if at < 0:
            return at
        if _PLAIN not in _groups(specs):
            raise ValueError("the feed keeps transformed elements only")
        path = self._path(f"fills/of={spec.name}")
        if self._exists(path):
            raise ValueError(f"view {spec.name} is filled already")
        versions = self.newest(at).filter(F.col("key").startswith(_PLAIN)).withColumn("sign", F.lit(1)).withColumn("role", F.lit(OWN))
        rows = cell_rows(versions, _body_type(elements, layout), layout, {_PLAIN: [spec]}, measure, rule)
        sums = rows.groupBy("cell", "level", "epoch").agg(F.sum("amount").alias("amount"))
        sums.select("cell", "level", "epoch", F.col("amount").cast(_kind(measure))).write.parquet(path)
        return at

    def newest(self, batch: int) -> DataFrame:
        """The newest versions that the feed's state holds after a micro-batch: ``key``, ``epoch``, ``order`` (its parts), ``body``."""
        checkpoint = self._path("checkpoint")
        operators = self._spark.read.format("state-metadata").load(checkpoint)
        holder = operators.filter(F.col("operatorProperties").contains('"stateName":"newest"')).first()["operatorId"]
        state = self._spark.read.format("statestore").option("operatorId", holder).option("stateVarName", "newest").option("batchId", batch).load(checkpoint)
        held = state.select(F.explode(entries(F.col("user_map_value.held"))).alias("e"))
        order = F.slice("e", F.lit(3), F.size("e") - 3).cast("array<bigint>").alias("order")
        return held.select(F.col("e")[0].alias("key"), F.col("e")[1].cast("bigint").alias("epoch"), order, F.element_at("e", -1).alias("body"))


SHUFFLE = "spark.sql.shuffle.partitions"

COUNTERS = "live counters"


def counted(elements: DataFrame, layout: Layout) -> DataFrame:
    """Elements that report, per micro-batch, how many rows, points and deletions they bring; see :class:`Counters`."""
    points = F.size(layout.points) if layout.is_nested(elements) else F.lit(1)
    return elements.observe(
        COUNTERS, F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum(points), F.lit(0)).cast("bigint").alias("points"),
        F.count(F.when(points == 0, 1)).alias("deletions"),
    )


class Counters(StreamingQueryListener):
    """Counts per micro-batch of streams made with :func:`counted`, and the rows that their states hold.

    Register it with ``spark.streams.addListener``. ``batches`` maps (query id, number of the micro-batch) to its counts, which replace those of
    an earlier run of it; only the last ``keep`` micro-batches stay, the totals count all.
    """

    def __init__(self, keep: int = 10_000):
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.totals: dict[str, int] = {"versions": 0, "points": 0, "deletions": 0}
        self._keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(COUNTERS)
        if found is None:
            return
        at, counts = (str(progress.id), progress.batchId), found.asDict()
        before = self.batches.pop(at, None)
        for name in self.totals:
            self.totals[name] += counts[name] - (before[name] if before else 0)
        counts["state_rows"] = sum(s.numRowsTotal for s in progress.stateOperators)
        self.batches[at] = counts
        while len(self.batches) > self._keep:
            self.batches.pop(next(iter(self.batches)))

    def wait_for(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until the last micro-batch of a query is counted; progress is told a moment after it is made."""
        last = query.lastProgress
        until = time.monotonic() + seconds
        while last is not None and COUNTERS in last.observedMetrics and (str(last.id), last.batchId) not in self.batches:
            if time.monotonic() > until:
                raise TimeoutError(f"micro-batch {last.batchId} is not told of")
            time.sleep(0.05)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
