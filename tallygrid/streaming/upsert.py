"""Streams of element versions turned into an append-only change log.

State is the newest version per key, kept in buckets of keys so that a task handles keys in bulk. When a newer version
arrives, the old numbers leave with the opposite sign and the new ones enter, so a running sum over the log always
equals the sum over the newest versions.

Before the shuffle, each task reduces its rows to the newest version per key and ``REDUCED`` rows. Versions that are
already superseded there need no state: they enter and leave on their own, spread over ``SPREAD`` groups. A key with
a large part of all input therefore sends only a few rows to the task that owns it. Versions travel in packs, as Spark hands single rows to a
stateful function one by one.

Whoever only sums needs no numbers of a version that enters and leaves within a micro-batch, but may have to know which cells it has touched. For
them, such versions are ``touches`` with the sign 0, told once per epoch and labels.
"""

from __future__ import annotations

import json
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import Layout
from ..operators.elements import flatten
from ..session import BATCH_BYTES, by_value, configured, ship
from .pages import Pages

by_value(__name__)

# Groups that share the versions superseded within a batch of rows.
SPREAD = 256
# Rows that a task reduces at a time, rows of one answer of a stateful function, and characters of a pack.
REDUCED = 1 << 16
ANSWER = 1 << 14
PACK = 1 << 13

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A pack is one row, so Spark's limit of rows alone would let what a Python worker gets at a time grow with the input.
SETTINGS = {STATE_STORE: ROCKSDB, BATCH_BYTES: str(4 << 20)}


def _as_long(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    raise TypeError(f"{name}: a stream is ordered by whole numbers, dates or timestamps, not {kind.simpleString()}")


def _from_long(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(column).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(column.cast("int"))
    return column.cast(kind)


# Bodies of several points of one version, as JSON objects, are put together with this.
BODY_SEPARATOR = "\n"

# What a missing part of an order counts as: before everything else.
MISSING = -(1 << 63)

#: Roles of a signed version: of the element itself, or of the baseline that is taken from it.
OWN, BASELINE = 0, 1


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows put together to at least ``REDUCED`` rows, or what is left."""
    held, count = [], 0
    for rows in batches:
        held.append(rows)
        count += len(rows)
        if count >= REDUCED:
            yield pd.concat(held, ignore_index=True)
            held, count = [], 0
    if count:
        yield pd.concat(held, ignore_index=True)


def _together(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """Sorted flat rows with the points of each version put together."""
    same = (rows[["key", *order]] == rows[["key", *order]].shift()).all(axis=1).to_numpy()
    if not same.any():
        return rows
    first = np.flatnonzero(~same)
    ends = [*first[1:].tolist(), len(rows)]

    def joined(texts: list[str]) -> list[str]:
        return [BODY_SEPARATOR.join(texts[a:b]) for a, b in zip(first.tolist(), ends)]

    return rows.iloc[first].assign(**{c: joined(rows[c].tolist()) for c in ("body", "touch") if c in rows}).reset_index(drop=True)


def _touches(rows: pd.DataFrame, starts: tuple[str, ...]) -> pd.DataFrame:
    """One of the superseded versions of each epoch, start of key and labels, with the labels as ``body``; equal ones meet in one of the groups that spread them."""
    rows = rows[rows["touch"].str.strip(BODY_SEPARATOR) != ""]
    rows = rows.assign(body=rows["touch"], start="" if len(starts) == 1 else [next(s for s in starts if k.startswith(s)) for k in rows["key"]])
    rows = rows.drop_duplicates(["epoch", "start", "body"])
    return rows.assign(bucket=[-1 - crc32(b.encode("utf-8", "surrogatepass")) % SPREAD for b in rows["body"]])


def _packs(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Versions of one bucket put into packs of about ``PACK`` characters; superseded ones, without a bucket, are spread by pack."""
    rows = rows.sort_values("bucket", kind="stable", ignore_index=True)
    bucket = rows["bucket"].to_numpy()
    part = rows["body"].str.len().to_numpy().cumsum() // PACK
    first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))).tolist()
    versions = list(zip(*[rows[c].tolist() for c in columns]))
    packed = []
    for a, b in zip(first, [*first[1:], len(rows)]):
        own = int(bucket[a])
        packed.append((own if own >= 0 else -1 - crc32(repr(versions[a]).encode("utf-8", "surrogatepass")) % SPREAD, pickle.dumps(versions[a:b], 5)))
    return pd.DataFrame(packed, columns=["bucket", "versions"])


def _newest_per_batch(order: list[str], nested: bool, touches: tuple[str, ...] = ()):
    """Per ``REDUCED`` rows, leave the newest version of each key and epoch in its bucket and spread the others over
    negative buckets, whatever their key. The points of a version in flat input are put together first. With ``touches``, the
    possible starts of keys, the others shrink to what they touch."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _gathered(batches):
            rows = rows.sort_values(["key", *order], kind="stable", ignore_index=True)
            rows = rows.drop_duplicates(["key", *order], ignore_index=True) if nested else _together(rows, order)
            following = rows[["key", "epoch"]].shift(-1)
            replaced = rows["key"].eq(following["key"]) & rows["epoch"].eq(following["epoch"])
            if touches:
                touched = _touches(rows[replaced], touches)
                if len(touched):
                    yield _packs(touched, ["key", *order, "body"])
                rows = rows[~replaced]
            else:
                rows["bucket"] = rows["bucket"].mask(replaced, -1)
            yield _packs(rows, ["key", *order, "body"])

    return reduce


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    for batch in batches:
        yield from map(pickle.loads, batch["versions"])


def _further(held: str, more: str, by_position: bool) -> str:
    """The points of ``more`` that a version does not hold yet.

    A point is known by its position where the input has one. Otherwise equal points are counted, and as many are further ones as there
    are more of them than held, so that a version sent again adds nothing.
    """
    points = [p for p in more.split(BODY_SEPARATOR) if p]
    if by_position:
        known = {json.loads(p)["p"] for p in held.split(BODY_SEPARATOR) if p}
        fresh = {}
        for p in points:
            fresh.setdefault(json.loads(p)["p"], p)
        return BODY_SEPARATOR.join(p for at, p in fresh.items() if at not in known)
    known = Counter(held.split(BODY_SEPARATOR))
    return BODY_SEPARATOR.join(p for point, count in Counter(points).items() for p in [point] * (count - known[point]))


class _KeepNewest(StatefulProcessor):
    """The newest version per key, in pages per bucket of keys. A bucket is one call, so keys are handled in bulk.

    With a ``suffix``, the element of a key and its baseline, the element of that key with the suffix, lie in the same bucket; keys that
    start with one of ``paired`` also emit the baseline's numbers, in the role ``BASELINE`` and under the element's key, whenever either of them changes.
    With ``touches``, the starts of keys, versions that enter and leave have the sign 0.
    """

    def __init__(self, order: list[str], nested: bool, by_position: bool = False, suffix: str = "", paired: tuple[str, ...] = (),
                 touches: tuple[str, ...] = ()) -> None:
        self._columns = ["key", *order, "body"]
        self._nested, self._by_position = nested, by_position
        self._suffix, self._paired = suffix, paired
        self._touches = touches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = Pages(handle, "newest")

    def _held(self, owner: str) -> tuple | None:
        held = self._newest.get(owner)
        return None if held is None else tuple(held)

    def _signed(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self._columns, "sign", "role"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signed = []
        if key[0] < 0:
            told: set[tuple] = set()
            for versions in _unpacked(rows):
                if self._touches:
                    for version in versions:
                        touch = version[1], next(s for s in self._touches if version[0].startswith(s)), version[-1]
                        if touch not in told:
                            told.add(touch)
                            signed.append((*version, 0, OWN))
                else:
                    signed += [(*version, sign, OWN) for version in versions for sign in (1, -1)]
                if len(told) >= ANSWER:
                    told = set()
                if len(signed) >= ANSWER:
                    yield self._signed(signed)
                    signed = []
            if signed:
                yield self._signed(signed)
            return
        arrived: dict[str, dict[tuple, tuple]] = {}
        for versions in _unpacked(rows):
            for owner, *version in versions:
                own, at = arrived.setdefault(owner, {}), tuple(version[:-1])
                if at in own and not self._nested:
                    version[-1] = own[at][-1] + BODY_SEPARATOR + version[-1]
                own.setdefault(at, tuple(version))
                if not self._nested:
                    own[at] = tuple(version)
        self._newest.open()
        changed: dict[str, tuple[tuple | None, tuple | None]] = {}
        for owner, versions in arrived.items():
            before = held = self._held(owner)
            entered = None  # where the whole version that is held has entered in this call
            for at in sorted(versions):
                if held is not None and at == held[:-1] and not self._nested:
                    more = _further(held[-1], versions[at][-1], self._by_position)
                    if more:
                        signed.append((owner, *at, more, 1, OWN))
                        held = (*at, BODY_SEPARATOR.join(b for b in (held[-1], more) if b))
                        entered = None
                    continue
                if held is not None and at <= held[:-1]:
                    continue
                if held is not None and held[0] == at[0]:
                    if self._touches and entered is not None:
                        signed[entered] = (owner, *held, 0, OWN)
                    else:
                        signed.append((owner, *held, -1, OWN))
                held = versions[at]
                if self._by_position:
                    held = (*held[:-1], _further("", held[-1], True))
                entered = len(signed)
                signed.append((owner, *held, 1, OWN))
            if held is not before:
                self._newest.put(owner, held)
                changed[owner] = before, held
        if self._suffix:
            signed += self._baselines(changed)
        self._newest.save()
        for start in range(0, len(signed), ANSWER):
            yield self._signed(signed[start:start + ANSWER])

    def _baselines(self, changed: dict[str, tuple[tuple | None, tuple | None]]) -> list[tuple]:
        """What the baselines of elements add and no longer add, after changes of either."""
        signed = []
        own = {k for k in changed if k.startswith(self._paired)}
        own |= {k.removesuffix(self._suffix) for k in own if k.endswith(self._suffix)}
        for element in sorted(own):
            pair = []
            for k in (element, element + self._suffix):
                now = self._held(k) if k not in changed else None
                pair.append(changed.get(k, (now, now)))
            (element_was, element_is), (baseline_was, baseline_is) = pair

            def matched(one, other):
                return other if one is not None and other is not None and one[0] == other[0] else None

            was, now = matched(element_was, baseline_was), matched(element_is, baseline_is)
            if was == now:
                continue
            if was is not None and (element_is is None or element_is[0] == was[0]):
                signed.append((element, *was, -1, BASELINE))
            if now is not None:
                signed.append((element, *now, 1, BASELINE))
        return signed

    def close(self) -> None:
        pass


def _order_names(layout: Layout, ties: bool) -> list[str]:
    return ["epoch", *[f"q{i}" for i in range(len(layout.seq))], *(["tie"] if ties else [])]


def _body_type(df: DataFrame, layout: Layout) -> T.StructType:
    """What a version holds besides key and order; of flat input, one point with its position as ``p``."""
    if layout.is_nested(df):
        return T.StructType([df.schema[c] for c in (*layout.core, layout.points)])
    own = T.StructType([df.schema[c] for c in (*layout.attributes, layout.value)])
    return own.add("p", df.schema[layout.pos].dataType) if layout.pos in df.columns else own


def _touch(df: DataFrame, layout: Layout) -> Column:
    """The body of a version whose numbers do not matter: labels, and 0 for every number that is not missing."""
    if layout.is_nested(df):
        points = F.transform(layout.points, lambda p: p.withField(layout.value, F.when(p[layout.value].isNotNull(), 0)))
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in layout.core], points.alias(layout.points)))
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in layout.attributes], F.when(F.col(f"`{layout.value}`").isNotNull(), 0).alias(layout.value)))


def key_text(column: Column) -> Column:
    """A key as text that tells a missing one from any other."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), column.cast("string")))


def bodies(versions: DataFrame, body_type: T.StructType) -> DataFrame:
    """Versions with their ``body`` text read again: one row per JSON object in it, as columns."""
    texts = F.concat(F.lit("["), F.replace("body", F.lit(BODY_SEPARATOR), F.lit(",")), F.lit("]"))
    return versions.select(*[c for c in versions.columns if c != "body"], F.explode(F.from_json(texts, T.ArrayType(body_type))).alias("_body"))


def signed_versions(df: DataFrame, layout: Layout, epoch: str | None = None, buckets: int = 1024, prefix: Column | None = None,
                    empty: Column | None = None, suffix: str = "", paired: tuple[str, ...] = (), touches: tuple[str, ...] = ()) -> DataFrame:
    """A stream of versions as signed ones: ``key`` (text), ``epoch``, the parts of the order as longs ``q0`` ..., ``body`` (JSON), ``sign``, ``role``.

    ``prefix`` keeps several kinds of elements apart that share their keys. Where ``empty`` holds, the version has no points and
    comes just before any other of the same order. Missing parts of an order count as before everything else, and a missing key is a key.
    ``suffix`` and ``paired`` (prefixes) emit baselines too. With ``touches``, all values of ``prefix``, a version that enters and leaves within a
    micro-batch comes with the sign 0, and may stand for others of its epoch, prefix and labels.
    """
    ship(df.sparkSession)
    order, nested = _order_names(layout, empty is not None), layout.is_nested(df)
    own = F.col(f"`{layout.key}`").cast("string")
    text = key_text(own) if prefix is None else F.concat(prefix, key_text(own))
    root = F.regexp_replace(own, f"({re.escape(suffix)})+$", "") if suffix else own
    fields = [F.col(f"`{c.name}`") for c in _body_type(df, layout).fields if c.name != "p"]
    if not nested and layout.pos in df.columns:
        fields.append(F.col(f"`{layout.pos}`").alias("p"))
    body = F.to_json(F.struct(*fields))
    ties = []
    if empty is not None:
        none = F.to_json(F.struct(*[F.col(f"`{c}`") for c in layout.core], F.array().cast(df.schema[layout.points].dataType).alias(layout.points))) if nested else F.lit("")
        body = F.when(empty, none).otherwise(body)
        ties = [F.when(empty, 0).otherwise(1).cast("bigint").alias("tie")]
    touch = _touch(df, layout) if touches else None
    if touches and empty is not None:
        touch = F.when(empty, F.lit("")).otherwise(touch)
    longs = [F.col(f"`{epoch}`").cast("bigint") if epoch else F.lit(0).cast("bigint"), *[_as_long(df, c) for c in layout.seq]]
    coded = df.select(
        text.alias("key"), *[F.coalesce(c, F.lit(MISSING).cast("bigint")).alias(n) for c, n in zip(longs, order)], *ties, body.alias("body"),
        *([touch.alias("touch")] if touches else []), F.pmod(F.xxhash64(root), F.lit(buckets)).alias("bucket"),
    )
    typed = ", ".join(f"{c} bigint" for c in order)
    reduced = coded.mapInPandas(_newest_per_batch(order, nested, touches), "bucket bigint, versions binary")
    return reduced.groupBy("bucket").transformWithStateInPandas(
        _KeepNewest(order, nested, not nested and layout.pos in df.columns, suffix, paired, touches),
        outputStructType=f"key string, {typed}, body string, sign int, role int",
        outputMode="append",
        timeMode="none",
    )


def _restored(name: str, kind: T.DataType) -> Column:
    return F.when(F.col(name) != MISSING, _from_long(F.col(name), kind)).alias(name)


def changelog_stream(df: DataFrame, layout: Layout, epoch: str | None = None, buckets: int = 1024) -> DataFrame:
    """The change log of a stream of element versions: key, ``seq``, labels, signed number and ``sign``.

    A version whose ``seq`` is not above the stored one is dropped. Deleting is sending a version without points. In flat
    input, rows with the same key and ``seq`` are the points of one version, whenever they arrive; a row sent again adds nothing. Points
    are told apart by the column ``layout.pos``, or, without it, counted by content: equal points of a version must then arrive in one micro-batch.
    A null key is a key, and a null in ``seq`` or in the epoch comes before all other values, as in the batch form.
    With ``epoch``, a whole-number column, a version of a later epoch replaces without a negative entry, because
    sums are kept per epoch.

    A task sorts what one micro-batch brings for one of ``buckets`` groups of keys; bound micro-batches with the options
    of the source. The number must stay the same for a checkpoint, as must Spark's own number of state partitions.
    """
    log = signed_versions(df, layout, epoch, buckets)
    key = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).cast(df.schema[layout.key].dataType)
    names = dict(zip(_order_names(layout, False)[1:], layout.seq))
    columns = [
        key.alias(layout.key),
        *([_restored("epoch", df.schema[epoch].dataType).alias(epoch)] if epoch else []),
        *[_restored(q, df.schema[c].dataType).alias(c) for q, c in names.items()],
        "sign", "body",
    ]
    opened = bodies(log.select(*columns), _body_type(df, layout)).select("*", "_body.*").drop("_body")
    rows = flatten(opened, layout)
    if "p" in rows.columns and layout.pos not in layout.attributes and not layout.is_nested(df) and layout.pos in df.columns:
        rows = rows.withColumnRenamed("p", layout.pos)
    value = F.col(layout.value)
    return rows.withColumn(layout.value, F.when(F.col("sign") < 0, -value).otherwise(value))


def run_changelog(log: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                  every: str | None = None) -> StreamingQuery:
    """Write the change log to a folder, once per entry, restartable from ``checkpoint``.

    The state lives in RocksDB, which is set for this query only if the session names another store.
    """
    spark = ship(log.sparkSession)
    writer = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    with configured(spark, SETTINGS):
        return writer.start(path)
