"""Set similarity self-join of documents on word shingles, by partitioning the universe of shingles.

Two sets of sizes r <= s with a Jaccard similarity of 0.75 or more differ in at most (r + s) / 7 elements. Every size band has its
own partition of the universe into segments (by hash). A set is indexed under its own band and, if a set of the next
band can still be similar, under that one too. The pigeonhole then gives two kinds of signatures:

* Large bands: one signature per segment. A set of size s that differs from another in at most H = 2s / 7 elements shares all
  but H of its segments with it, so it suffices to look at any H + 1 of them. Each set takes those that cost least,
  by the number of sets in their groups, as counted over the whole corpus; segments nobody else shares cost nothing.
* Small bands (``_DELETIONS``): half as many segments, of which one must be equal or differ by one element. It is indexed with all its
  one-deletion neighbours; the segments are few, so the neighbours cost little there.

An empty segment says nothing, so it is left out, except for the rare sets with fewer than H + 1 others.

Equal sets of one slice of a batch are folded into one first, so a group of copies sends one entry per slice. Groups of the chosen
signatures are resolved without forming all pairs: every set that chose a signature is verified against the member that shares most
with others, links become components, and a second round takes only groups of three or more that still hold several components, and
there verifies a set only with members of other components. Ids alone travel with the signatures; sizes and parity sketches, which
rule out most dissimilar pairs before their sets are fetched, join distinct pairs in the first round and open groups in the second.
Before the second round, every shingle of the sets in open groups is looked up: one that a single component holds is common to no pair
that is left. A set with too many of them is done, which closes most groups; in the others, sketches tell of the rest of each set only.
Each component is what all links of the join would give. Verification counts the common shingles (64-bit hashes) of both whole sets.

A null or empty text has no shingles, is linked with nothing and is its own component. Rows with a null id are not returned.
Rows that repeat an id (and its text) each return the same. Ties cannot occur. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, checkpointed, configured, new_work_dir
from .common import SLICE_BYTES, bucket_count, by_bucket, documents, encoded, let_go, pack, slices, text_bytes, unpacked
from .components import components
from .hashing import Runs, lower_ascii, mix, word_hashes

#: Similar pairs have 100 * common >= PERCENT * all. The partition's bounds follow from it.
PERCENT = 75
SHINGLE = 5
_RATIO = 1.5
#: Bands of sets up to this size use one-deletion neighbourhoods.
_DELETIONS = 32
_MEMBERS = 64
#: An entry: 32 bits of the signature beside its bucket (a clash only adds a candidate), document, flags.
_ENTRY = (4, "i8", "u1")
#: Bits of the filter that keeps documents without partners out of the shuffle of texts. Its size is fixed, whatever the input.
_FILTER_BITS = 22
#: Words of 64 bits of a set's parity sketch.
_WORDS = 8
_INFO = ("i8", "i4", "i8", "i4", *("i8",) * _WORDS)
_SKETCH = [f"k{i}" for i in range(_WORDS)]
#: A shingle of an open set (32 bits beside its bucket and its slot in the sketch; a clash only counts as common) with its document and
#: component, and the slot of one that a single component holds.
_HELD, _ALONE = (4, "u2", "i8", "i8"), ("i8", "u2")
_ENTRY_ROW, _INFO_ROW = 0, 1
_PROBES, _SURE, _EMPTY, _LACKING = 1, 2, 4, 8
_DECIDED = "kind int, doc_id long, n int, rep long, units int, sig long, size int, flags int, " + ", ".join(f"{k} long" for k in _SKETCH)


def _edges() -> np.ndarray:
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, int(found[-1] * _RATIO)))
    return np.array(found, dtype=np.int64)


_EDGES = _edges()


def most_different(n: int) -> int:
    """How many elements a set of size n and a similar one, no larger, can differ in."""
    return 2 * n * (100 - PERCENT) // (100 + PERCENT)


def shingles(text: bytes, length: int = SHINGLE) -> np.ndarray:
    """The set of a document: sorted hashes of its runs of ``length`` words, or of all words if there are fewer."""
    words = word_hashes(lower_ascii(text))[0]
    if not len(words):
        return words
    return np.unique(Runs(words).all(min(length, len(words))))


def _segments(values: np.ndarray, count: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _signature(content: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(content + mix(segment + np.uint64(band << 40)))


def signatures(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set with their flags, and the units it has to spend in its own band."""
    n = len(values)
    own = int(np.searchsorted(_EDGES, n, side="right")) - 1
    found, flags, units = [], [], 0
    for band in (own, own + 1):
        if band > own and n * 100 < PERCENT * _EDGES[band]:
            continue
        most = most_different(int(_EDGES[band + 1]) - 1) + 1
        small = _EDGES[band + 1] - 1 <= _DELETIONS
        count = -(-most // 2) if small else most + most // 10 + 4
        segment = _segments(values, count)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        content = np.add.reduceat(mix(values), first)
        filled = segment[first]
        empty = np.setdiff1d(np.arange(count, dtype=np.uint64), filled, assume_unique=True)
        whole = _signature(content, filled, band)
        blank = _signature(np.zeros(len(empty), dtype=np.uint64), empty, band)
        if small:
            lengths = np.diff(np.append(first, n))
            without = _signature(np.repeat(content, lengths) - mix(values), segment, band)
            found += [whole, blank, without]
            flags += [np.full(len(whole) + len(blank), _SURE), np.zeros(len(without))]
            continue
        lacking = band == own and len(whole) < most_different(n) + 1
        mark = (_PROBES if band == own else 0) | (_LACKING if lacking else 0)
        found += [whole, blank]
        flags += [np.full(len(whole), mark), np.full(len(blank), mark | _EMPTY)]
        if band == own:
            units = count if lacking else len(whole)
    return np.concatenate(found), np.concatenate(flags).astype(np.uint8), units


def sketch(values: np.ndarray) -> list[int]:
    """Parities of the numbers of elements in ``64 * _WORDS`` slots. Two sets differ in at least as many elements as their
    sketches do in bits, so a pair whose sketches differ in too many bits cannot be similar."""
    return _parities(np.bincount(_slots(values), minlength=64 * _WORDS)).tolist()


def _slots(values: np.ndarray) -> np.ndarray:
    return (mix(values ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * _WORDS)).astype(np.int64)


def _parities(counts: np.ndarray) -> np.ndarray:
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def _entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches):
            docs = [(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"))) if d is not None]
            docs.sort(key=lambda x: x[0])
            known: dict = {}
            info, parts = [], []
            for doc, text in docs:
                values = shingles(text)
                if not len(values):
                    info.append((doc, 0, doc, 0, *(0,) * _WORDS))
                    continue
                key = values.tobytes()
                if key in known:
                    info.append((doc, len(values), known[key], 0, *(0,) * _WORDS))
                    continue
                known[key] = doc
                found, flags, units = signatures(values)
                info.append((doc, len(values), doc, units, *sketch(values)))
                parts.append((found, np.full(len(found), doc), flags))
            if not info:
                continue
            columns = [np.array(c) for c in zip(*info)]
            rows = [(-1 - bucket, pack(_INFO, *(c[own] for c in columns))) for bucket, own in by_bucket(columns[0] % buckets)]
            if parts:
                found, doc, flags = (np.concatenate(p) for p in zip(*parts))
                for bucket, own in by_bucket((found % np.uint64(buckets)).astype(np.int64)):
                    rows.append((bucket, pack(_ENTRY, found[own] >> np.uint64(32), doc[own], flags[own])))
            yield _blob_rows(rows)

    return run


def _rows(kind: int, doc, n=None, rep=None, units=None, sig=None, size=None, flags=None, words=(None,) * _WORDS) -> pa.Table:
    count = len(doc)
    types = (("n", n, pa.int32()), ("rep", rep, pa.int64()), ("units", units, pa.int32()), ("sig", sig, pa.int64()), ("size", size, pa.int32()), ("flags", flags, pa.int32()), *((k, w, pa.int64()) for k, w in zip(_SKETCH, words)))
    columns = {"kind": pa.array(np.full(count, kind), pa.int32()), "doc_id": pa.array(doc, pa.int64())}
    return pa.table(columns | {name: pa.nulls(count, t) if x is None else pa.array(x, t) for name, x, t in types})


def _groups(buckets: int):
    def run(key, group):
        """Signatures that several sets share, with the size of their groups; information rows pass."""
        bucket, blobs = key[0].as_py(), group.column("blob").to_pylist()
        if bucket < 0:
            doc, n, rep, units, *words = unpacked(_INFO, blobs)
            return _rows(_INFO_ROW, doc, n=n, rep=rep, units=units, words=words)
        sig, doc, flags = unpacked(_ENTRY, blobs)
        order = np.argsort(sig, kind="stable")
        sig, doc, flags = sig[order], doc[order], flags[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        any_flag = np.bitwise_or.reduceat(flags, first) if len(sig) else flags
        # A group of blank segments matters only if one of its sets lacks a shingle; a segment that clashes with blank ones always does.
        any_real = np.bitwise_or.reduceat((flags & _EMPTY) == 0, first) if len(sig) else np.zeros(0, bool)
        wanted = (size > 1) & ((any_flag & (_PROBES | _SURE)) > 0) & (any_real | ((any_flag & _LACKING) > 0))
        kept = np.repeat(wanted, size)
        whole = sig[kept].astype(np.int64) * buckets + bucket
        return _rows(_ENTRY_ROW, doc[kept], sig=whole, size=np.repeat(size, size)[kept], flags=flags[kept].astype(np.int32))

    return run


def _own_sets(found: DataFrame) -> DataFrame:
    """The sets that stand for themselves, not for another one of equal content."""
    return found.filter((F.col("kind") == _INFO_ROW) & (F.col("n") > 0) & (F.col("rep") == F.col("doc_id"))).dropDuplicates(["doc_id"])


def _chosen(found: DataFrame, sets: DataFrame) -> DataFrame:
    """What each set looks at: ``sig``, ``s`` and ``sure`` (small bands, where all signatures count)."""
    entries = found.filter(F.col("kind") == _ENTRY_ROW)
    sure = entries.filter(F.col("flags").bitwiseAND(_SURE) > 0).select("sig", F.col("doc_id").alias("s")).distinct()
    usable = (F.col("flags").bitwiseAND(_PROBES) > 0) & ((F.col("flags").bitwiseAND(_EMPTY) == 0) | (F.col("flags").bitwiseAND(_LACKING) > 0))
    offered = entries.filter(usable).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("size", "sig"))).alias("offered"))
    most = F.floor(F.col("n") * (2 * (100 - PERCENT)) / F.lit(100 + PERCENT)).cast("int") + 1
    needed = most - (F.col("units") - F.size("offered"))
    taken = offered.join(sets.select("doc_id", "n", "units"), "doc_id").withColumn("needed", needed).filter("needed > 0")
    taken = taken.select("doc_id", F.explode(F.slice("offered", F.lit(1), F.col("needed"))).alias("o")).select("o.sig", F.col("doc_id").alias("s")).distinct()
    return sure.withColumn("sure", F.lit(True)).unionByName(taken.withColumn("sure", F.lit(False)))


def _members(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """All sets of the groups of chosen signatures: ``sig``, ``r``."""
    entries = found.filter(F.col("kind") == _ENTRY_ROW).select("sig", F.col("doc_id").alias("r")).distinct()
    return entries.join(chosen.select("sig").distinct(), "sig", "left_semi")


def _described(frame: DataFrame, sets: DataFrame, column: str, side: str) -> DataFrame:
    """``frame`` with the size, the number of shingles that can be common, and the sketch of the sets in a column, named after ``s`` or ``r``."""
    named = sets.select(F.col("doc_id").alias(column), F.col("n").alias(f"n_{side}"), F.col("shared").alias(f"shared_{side}"), *(F.col(k).alias(f"{side}_{k}") for k in _SKETCH))
    return frame.join(named, column)


def _enough(shared: Column, n_s: Column, n_r: Column) -> Column:
    """Whether so many common shingles would make sets of these sizes similar."""
    return (100 + PERCENT) * shared >= PERCENT * (n_s + n_r)


def _may_be_similar() -> Column:
    """What sizes, shingles that can be common, and sketches of those allow; never false for a similar pair."""
    bits = reduce(add, (F.bit_count(F.col(f"s_{k}").bitwiseXOR(F.col(f"r_{k}"))) for k in _SKETCH))
    both = F.col("n_s") + F.col("n_r")
    alone = both - F.col("shared_s") - F.col("shared_r")
    fits = _enough(F.least("shared_s", "shared_r"), F.col("n_s"), F.col("n_r"))
    return fits & ((100 + PERCENT) * (alone + bits) <= (100 - PERCENT) * both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of a document once per group of pairs that asks for it."""
    for batch in slices(batches):
        rows, size = [], 0
        for doc, text, asked in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), batch.column("asked").to_pylist()):
            if asked:
                values = shingles(text).astype("<u8").tobytes()
                rows += [(a["key"], a["part"], doc, values) for a in asked]
                size += len(asked) * len(values)
            if size >= SLICE_BYTES:
                yield _set_rows(rows)
                rows, size = [], 0
        yield _set_rows(rows)


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["key", "part", "doc_id", "values"])


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of distinct numbers reach the similarity, exactly."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= PERCENT * (len(one) + len(other) - common) and common > 0


def _verified(key, group):
    leader = key[0].as_py()
    sets = dict(zip(group.column("doc_id").to_pylist(), group.column("values").to_pylist()))
    first = np.frombuffer(sets[leader], dtype="<u8")
    linked = [d for d, values in sets.items() if d != leader and similar(first, np.frombuffer(values, dtype="<u8"))]
    return pa.table({"a": pa.array([leader] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})


def _likely(ids: DataFrame) -> np.ndarray:
    """A bit per slot that holds any of the ids; the words are put together by Spark, and there are as many whatever the input."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS))
    placed = ids.withColumn("slot", slot)
    words = placed.select((F.col("slot") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 32 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (_FILTER_BITS - 5), dtype=np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _filtered(likely: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(likely, dtype=np.uint32)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            keep = (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    return run


def _with_texts(docs: DataFrame, asked: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``asked`` with the texts of their documents, which ``ids`` lists; most other texts stay out of the shuffle."""
    likely = _likely(ids)
    slotted = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS)))
    return slotted.mapInArrow(_filtered(likely.tobytes()), "doc_id long, text string").join(asked, "doc_id")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``, distinct) whose sets are similar. The partners of a document are verified in parts of bounded size."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    leaders = parts.select(F.col("a").alias("doc_id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = members.unionByName(leaders).groupBy("doc_id").agg(F.collect_list(F.struct("key", "part")).alias("asked"))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = _with_texts(docs, asked, ids).mapInArrow(_sets, "key long, part int, doc_id long, values binary")
    return sets.groupBy("key", "part").applyInArrow(_verified, "a long, b long")


def _leader_pairs(found: DataFrame, chosen: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets with the leader of each group they look at: the member that shares most with others, as the origin of copies does."""
    central = found.filter(F.col("kind") == _ENTRY_ROW).groupBy(F.col("doc_id").alias("r")).agg(F.sum("size").alias("central"))
    leader = F.max_by("r", F.struct("central", -F.col("r"))).alias("a")
    leaders = members.join(central, "r").groupBy("sig").agg(leader, F.count("*").alias("many"), F.min("r").alias("low"), F.max("r").alias("high"))
    # In a group of two the leader may be the one that looks.
    other = F.when((F.col("many") == 2) & (F.col("s") == F.col("a")), F.when(F.col("low") == F.col("a"), F.col("high")).otherwise(F.col("low"))).otherwise(F.col("s"))
    pairs = chosen.join(leaders, "sig").select("a", other.alias("b")).filter("a <> b").distinct()
    whole = sets.withColumn("shared", F.col("n"))
    return _described(_described(pairs, whole, "a", "r"), whole, "b", "s").filter(_may_be_similar()).select("a", "b")


def _held(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of open sets by bucket, each with its document and component."""
        for batch in slices(batches):
            known = zip(batch.column("doc_id").to_pylist(), batch.column("component").to_pylist(), encoded(batch.column("text")))
            parts = [(values, np.full(len(values), d), np.full(len(values), c)) for d, c, values in ((d, c, shingles(t)) for d, c, t in known)]
            values, doc, component = (np.concatenate(p) for p in zip(*parts))
            slot = _slots(values)
            rows = [(b, pack(_HELD, values[own] >> np.uint64(32), slot[own], doc[own], component[own])) for b, own in by_bucket((values % np.uint64(buckets)).astype(np.int64))]
            yield _blob_rows(rows)

    return run


def _blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _alone(buckets: int):
    def run(key, group):
        """The shingles that a single component holds, by bucket of their documents."""
        values, slot, doc, component = unpacked(_HELD, group.column("blob").to_pylist())
        values = (values << np.uint64(16)) | slot
        order = np.lexsort((doc, values))
        # A document may come in several rows.
        order = order[np.concatenate(([True], (np.diff(values[order]) != 0) | (np.diff(doc[order]) != 0)))]
        values, slot, doc, component = values[order], slot[order], doc[order], component[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        alone = np.minimum.reduceat(component, first) == np.maximum.reduceat(component, first)
        kept = np.repeat(alone, np.diff(np.append(first, len(values))))
        doc, slot = doc[kept], slot[kept]
        rows = [(b, pack(_ALONE, doc[own], slot[own])) for b, own in by_bucket(doc % buckets)]
        return pa.Table.from_batches([_blob_rows(rows)])

    return run


def _counted(key, group):
    """Per document the number of shingles that its component alone holds, and their parities."""
    doc, slot = unpacked(_ALONE, group.column("blob").to_pylist())
    docs, at = np.unique(doc, return_inverse=True)
    counts = np.bincount(at * (64 * _WORDS) + slot, minlength=len(docs) * 64 * _WORDS)
    words = _parities(counts).reshape(len(docs), _WORDS)
    columns = {"doc_id": pa.array(docs, pa.int64()), "alone": pa.array(np.bincount(at, minlength=len(docs)), pa.int32())}
    return pa.table(columns | {f"a_{k}": pa.array(np.ascontiguousarray(words[:, i]), pa.int64()) for i, k in enumerate(_SKETCH)})


def _still_possible(docs: DataFrame, sets: DataFrame, asked: DataFrame) -> DataFrame:
    """Which of the sets in open groups (``doc_id``, ``component``) can be similar to one of another component, as rows of ``sets``, with
    the number of shingles that several components hold as ``shared`` and sketches of just these."""
    own = checkpointed(sets.join(asked, "doc_id"))
    buckets = bucket_count(24 * (own.select(F.sum("n")).first()[0] or 0))
    asked = own.select("doc_id", "component")
    entries = _with_texts(docs, asked, asked.select("doc_id")).mapInArrow(_held(buckets), "bucket int, blob binary")
    alone = entries.groupBy("bucket").applyInArrow(_alone(buckets), "bucket int, blob binary")
    counted = alone.groupBy("bucket").applyInArrow(_counted, "doc_id long, alone int, " + ", ".join(f"a_{k} long" for k in _SKETCH))
    told = own.join(counted, "doc_id", "left")
    parities = [F.col(k).bitwiseXOR(F.coalesce(f"a_{k}", F.lit(0).cast("long"))).alias(k) for k in _SKETCH]
    shared = (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")
    return told.select("doc_id", "n", shared, *parities).filter(100 * F.col("shared") >= PERCENT * F.col("n"))


def _open_pairs(docs: DataFrame, chosen: DataFrame, members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets and members of a group they look at that are still in different components and may be similar.

    Groups of two were judged when their leader was, and groups of one component are done. Of the others, only sets stay that share enough
    shingles with other components. There a set first meets the components; one with a single member is judged at once. Members are listed
    only for components that are not the set's own and hold sizes that fit.
    """

    def labelled(frame: DataFrame, column: str, out: str) -> DataFrame:
        named = frame.join(labels.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left")
        return named.withColumn(out, F.coalesce(out, column))

    def still_open(placed: DataFrame, least: int) -> DataFrame:
        several_parts = (F.count("*") > least) & (F.min("other") < F.max("other"))
        return placed.join(placed.groupBy("sig").agg(several_parts.alias("open")).filter("open").select("sig"), "sig", "left_semi")

    placed = checkpointed(still_open(checkpointed(labelled(members, "r", "other")), 2))
    possible = checkpointed(_still_possible(docs, sets, placed.select(F.col("r").alias("doc_id"), F.col("other").alias("component")).distinct()))
    own = checkpointed(still_open(_described(placed, possible, "r", "r"), 1))
    looking = _described(labelled(chosen.join(own.select("sig").distinct(), "sig", "left_semi"), "s", "one"), possible, "s", "s")
    about = ["r", "n_r", "shared_r", *(f"r_{k}" for k in _SKETCH)]
    most = [F.max("n_r").alias("most_n"), F.max("shared_r").alias("most_shared")]
    parts = own.groupBy("sig", "other").agg(F.count("*").alias("many"), *(F.min(c).alias(c) for c in about), *most)
    wanted = _may_be_similar() & (F.col("sure") | (F.col("n_r") <= F.col("n_s")))
    # In a part of several, n_r is the least size.
    some = _enough(F.least("shared_s", "most_shared"), F.col("n_s"), F.col("n_r")) & (100 * F.col("most_n") >= PERCENT * F.col("n_s"))
    sides = looking.alias("c").join(
        parts.alias("p"), (F.col("c.sig") == F.col("p.sig")) & (F.col("one") != F.col("other")) & F.when(F.col("many") > 1, some).otherwise(wanted)
    ).select("c.*", "other", "many", "r")
    sides = checkpointed(sides)
    single = sides.filter("many = 1").select("s", "r")
    several = sides.filter("many > 1").drop("r").alias("c").join(
        own.alias("m"), (F.col("c.sig") == F.col("m.sig")) & (F.col("c.other") == F.col("m.other")) & wanted
    ).select("s", "r")
    return single.unionByName(several).select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()


def _united(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links, which now link the ones there are."""
    if more.isEmpty():
        return labels
    ends = more
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    wider = checkpointed(components(ends.select("a", "b")).withColumnRenamed("component", "wider"))
    within = labels.join(wider.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    lone = wider.join(labels, "node", "left_anti").select("node", F.col("wider").alias("component"))
    return checkpointed(within.unionByName(lone))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_shingles`` and ``component_id`` (the least document it reaches over links)."""
    # A worker cuts what it gets into slices of this size anyway; larger batches would only lie in memory, in the JVM as well.
    with configured(docs.sparkSession, {BATCH_BYTES: str(SLICE_BYTES)}):
        return _labelled(documents(docs, id_col, text_col))


def _labelled(own: DataFrame) -> DataFrame:
    spark = own.sparkSession
    buckets = bucket_count(text_bytes(own))
    path = new_work_dir(spark, "jaccard")
    entries = own.mapInArrow(_entries(buckets), "bucket int, blob binary")
    entries.groupBy("bucket").applyInArrow(_groups(buckets), _DECIDED).write.parquet(path)
    found = spark.read.schema(_DECIDED).parquet(path)
    sets = checkpointed(_own_sets(found).select("doc_id", "n", "units", *_SKETCH))
    chosen = checkpointed(_chosen(found, sets))
    members = checkpointed(_members(found, chosen))
    first = checkpointed(_leader_pairs(found, chosen, members, sets))
    links = checkpointed(_links(own, first))
    labels = checkpointed(components(links))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = checkpointed(_open_pairs(own, chosen, members, sets, labels).join(tried, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        labels = _united(labels, checkpointed(_links(own, second)))
    info = found.filter(F.col("kind") == _INFO_ROW).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "rep")
    labelled = info.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
