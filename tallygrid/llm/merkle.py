"""A Merkle manifest of a table, with nested-interval labels.

Rows become leaves. The leaves of a group (say, a language) are ranked and form a tree of their own; the roots of the groups, in the order of the
group values, form the tree on top. Every node carries the interval ``[lo, hi)`` of leaf ranks it covers, so ancestry is containment and no
node stores a parent: the children of a node are the nodes one level down inside its interval, and the siblings on a path are what is left of
the parent's interval without the node's own.

Nodes are kept by bands of ``band`` levels. A band is cut into blocks, each the part of a tree below one node of the band's last level, so a task
holds a few thousand nodes whatever the size of a group. Building goes upwards, one shuffle per band: a block takes the nodes at its
foot and makes those above. Proofs go downwards: the nodes of a block meet, in a join on (tree, block), the nodes at its foot and the one path that leads
from the block to the root; inside, containment finds the ancestors of every level. So the long paths of leaves are never shuffled.

Digests are SHA-256 over the hexadecimal text of the children. A level of a single node ends a tree, so a lone leaf is its own root; a last run
that is not full is hashed as it is, even if it is one node.

Defined results: null values are written as ``-`` in leaves, null groups come first, rows with a null order value come first in their group; rows
that tie are ordered by their leaf, and rows equal in all hashed columns have equal leaves, whose places are interchangeable. Texts are hashed whole, of any
length, and do not travel. Columns that are not named are ignored, whatever their names. An empty table has no nodes and no proofs.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ordered_chunks
from ..session import checkpointed, new_work_dir, ship

FANOUT = 2
BAND = 10
_DIGEST = 32
#: The tree over the roots of all groups; group trees are named "" for null, else "=" and the value.
_TOP = "+"
_PARTITION_BITS = 33

_NODES = "tree string, n long, level int, lo long, hi long, digest binary"
_ABOVE = "siblings array<binary>, positions array<int>, subroot binary, root binary"


def field(column: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and the value; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row over the given columns, as lower-case hex."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(start: Column, siblings: Column, positions: Column) -> Column:
    """The root that a leaf (hex) leads to with the siblings of each level, left to right, and its place among them."""

    def step(below: Column, level: Column) -> Column:
        texts = F.lower(F.hex(level["siblings"]))
        left = level["positions"] * (2 * _DIGEST)
        return F.sha2(F.concat(F.substring(texts, F.lit(1), left), below, F.substring(texts, left + 1, F.length(texts))), 256)

    return F.aggregate(F.arrays_zip(siblings.alias("siblings"), positions.alias("positions")), start, step)


def proof_digest(siblings: Column) -> Column:
    """The digest of all siblings of a path, from the leaf's level to the root's, each level left to right."""
    return F.sha2(F.concat_ws("", F.transform(siblings, lambda s: F.lower(F.hex(s)))), 256)


def _height(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their ``rank`` in their ``tree`` and the number ``n`` of its rows. A tree of any size is sorted by many tasks."""
    sorted_rows = ordered_chunks(rows, ["tree", *order]).drop("_chunk").withColumn("_part", F.shiftright("_at", _PARTITION_BITS))
    parts = sorted_rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    of_tree = Window.partitionBy("tree")
    earlier = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.select(
        "tree", "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(of_tree).alias("n")
    )
    joined = sorted_rows.join(places, ["tree", "_part"])
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _raised(base: int, band: int, fanout: int):
    """The nodes of a block above its foot, which is at level ``base``."""

    def run(key, group):
        group = group.sort_by("lo")
        tree, n = group["tree"][0].as_py(), group["n"][0].as_py()
        lo, hi = group["lo"].to_pylist(), group["hi"].to_pylist()
        texts = [d.hex().encode() for d in group["digest"].to_pylist()]
        made: list[tuple[int, int, int, bytes]] = []
        for level in range(base + 1, min(base + band, _height(n, fanout)) + 1):
            cuts = range(0, len(texts), fanout)
            digests = [hashlib.sha256(b"".join(texts[c : c + fanout])).digest() for c in cuts]
            lo, hi = [lo[c] for c in cuts], [hi[min(c + fanout, len(hi)) - 1] for c in cuts]
            texts = [d.hex().encode() for d in digests]
            made += zip([level] * len(lo), lo, hi, digests)
        levels, los, his, digests = zip(*made) if made else ((), (), (), ())
        return pa.table({
            "tree": pa.array([tree] * len(made), pa.string()), "n": pa.array([n] * len(made), pa.int64()), "level": pa.array(levels, pa.int32()),
            "lo": pa.array(los, pa.int64()), "hi": pa.array(his, pa.int64()), "digest": pa.array(digests, pa.binary()),
        })

    return run


def _paths(base: int, checked: bool = False):
    """Attach to each node at the foot of a block what leads from it to the root; or, ``checked``, only what comes of it."""

    def run(key, foot, block):
        above = block.filter(pc.is_valid(block["root"])).select(["siblings", "positions", "subroot", "root"]).to_pylist()[0]
        foot = foot.sort_by("lo")
        nodes = block.filter(pc.is_valid(block["level"])).sort_by("lo")
        by_level = np.array(nodes["level"].to_pylist(), dtype=np.int64)
        own_lo, own_hi = (foot[c].to_numpy() for c in ("lo", "hi"))
        digests = b"".join(foot["digest"].to_pylist())
        siblings: list[list[bytes]] = [[] for _ in own_lo]
        positions: list[list[int]] = [[] for _ in own_lo]
        below_lo, lo, hi = own_lo, own_lo, own_hi
        for level in range(base + 1, int(by_level.max(initial=base)) + 1):
            here = nodes.filter(pa.array(by_level == level))
            here_lo, here_hi = (here[c].to_numpy() for c in ("lo", "hi"))
            # The ancestor is the node whose interval contains the own one; its interval without the own one is the siblings'.
            ancestor = np.searchsorted(here_lo, lo, side="right") - 1
            if not ((here_lo[ancestor] <= lo) & (hi <= here_hi[ancestor])).all():
                raise ValueError(f"tree {key}: an interval of level {level - 1} is in none of level {level}")
            own = np.searchsorted(below_lo, lo)
            first = np.searchsorted(below_lo, here_lo[ancestor])
            last = np.searchsorted(below_lo, here_hi[ancestor])
            for i, (a, o, e) in enumerate(zip(first.tolist(), own.tolist(), last.tolist())):
                siblings[i].append(digests[a * _DIGEST : o * _DIGEST] + digests[(o + 1) * _DIGEST : e * _DIGEST])
                positions[i].append(o - a)
            lo, hi, below_lo = here_lo[ancestor], here_hi[ancestor], here_lo
            digests = b"".join(here["digest"].to_pylist())
        size = len(own_lo)
        if checked:
            found = []
            for own, claimed, near, places in zip(foot["digest"].to_pylist(), foot["claim"].to_pylist(), siblings, positions):
                path, folded = hashlib.sha256(), (own if claimed is None else claimed).hex()
                for level, place in zip((*near, *above["siblings"]), (*places, *above["positions"])):
                    text = level.hex()
                    path.update(text.encode())
                    cut = 2 * _DIGEST * place
                    folded = hashlib.sha256(f"{text[:cut]}{folded}{text[cut:]}".encode()).hexdigest()
                found.append((own.hex(), above["subroot"].hex(), above["root"].hex(), path.hexdigest(), folded))
            return pa.table([foot["payload"], *(pa.array(list(c), pa.string()) for c in zip(*found))], names=["payload", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
        return pa.table({
            "tree": foot["tree"], "n": foot["n"], "lo": foot["lo"], "hi": foot["hi"], "digest": foot["digest"], "payload": foot["payload"],
            "siblings": pa.array([s + above["siblings"] for s in siblings], pa.list_(pa.binary())),
            "positions": pa.array([p + above["positions"] for p in positions], pa.list_(pa.int32())),
            "subroot": pa.array([above["subroot"]] * size, pa.binary()), "root": pa.array([above["root"]] * size, pa.binary()),
        })

    return run


class Manifest:
    """The trees over a table of leaves.

    ``leaves`` has ``group`` (string), ``order`` (any type that sorts), ``digest`` (hex text) and ``payload``, a column that
    is handed through to the proofs; a column ``claim`` (hex text or null) is a leaf to be checked in place of the recorded one. Nodes are written below the session's shared folder and read from there.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, band: int = BAND):
        if fanout < 2 or band < 1:
            raise ValueError("a tree needs a fanout of at least 2 and bands of at least 1 level")
        self._spark = ship(leaves.sparkSession)
        self._fanout, self._band = fanout, band
        self._folder = new_work_dir(self._spark, "merkle")
        named = leaves.select(
            F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "group")).alias("tree"), "order", F.unhex("digest").alias("digest"), "payload",
            (F.unhex("claim") if "claim" in leaves.columns else F.lit(None).cast("binary")).alias("claim"),
        )
        self._leaves = _ranked(named, ["order", "digest"]).select(
            "tree", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "payload", "claim"
        )
        self._bands = self._built(self._leaves.drop("payload", "claim"), "groups")
        subroots = self._subroots(self._leaves.drop("payload", "claim"), self._bands)
        top = _ranked(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("payload"), "digest"), ["payload"])
        self._tops = checkpointed(top.select(
            "tree", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "payload"
        ))
        self._top_bands = self._built(self._tops.drop("payload"), "top")

    def _block(self, number: int) -> Column:
        return F.floor(F.col("lo") / F.lit(self._fanout ** (self._band * (number + 1)))).cast("long")

    def _built(self, foot: DataFrame, name: str) -> list[DataFrame]:
        """The nodes above the leaves, by band."""
        bands: list[DataFrame] = []
        largest = foot.agg(F.max("n")).first()[0] or 0
        for number in range(-(-_height(largest, self._fanout) // self._band)):
            raised = foot.withColumn("block", self._block(number)).groupBy("tree", "block").applyInArrow(
                _raised(number * self._band, self._band, self._fanout), _NODES
            )
            path = f"{self._folder}/{name}-{number}"
            raised.write.parquet(path)
            bands.append(self._spark.read.parquet(path))
            foot = bands[-1].filter(F.col("level") == (number + 1) * self._band)
        return bands

    def _subroots(self, leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
        """The last node of every tree: the one that covers all its leaves."""
        roots = leaves.filter("n = 1").select("tree", "n", "digest")
        for nodes in bands:
            roots = roots.unionByName(nodes.filter("lo = 0 and hi = n").select("tree", "n", "level", "digest").groupBy("tree", "n").agg(F.max_by("digest", "level").alias("digest")))
        return roots.groupBy("tree").agg(F.first("digest").alias("digest"))

    @property
    def nodes(self) -> DataFrame:
        """Every node: ``tree``, ``n`` leaves of the tree, ``level``, covered ranks ``lo`` to below ``hi``, ``digest``. The tree ``+`` is the one on top."""
        kept = ["tree", "n", "level", "lo", "hi", "digest"]
        found = self._leaves.select(*kept).unionByName(self._tops.select(*kept))
        for band in (*self._bands, *self._top_bands):
            found = found.unionByName(band)
        return found

    def _proved(self, leaves: DataFrame, bands: list[DataFrame], roots: DataFrame, checked: bool = False) -> DataFrame:
        """Leaves with the path to what ``roots`` (``tree``, ``n`` and what is above) says of their trees."""
        payload = leaves.schema["payload"].dataType.simpleString()
        above = None
        for number in reversed(range(max(1, len(bands)))):
            # A tree enters at the band that holds its root; trees that end below have nothing here.
            enters, foot = F.col("n") <= self._fanout ** (self._band * (number + 1)), leaves
            if number:
                reaches = F.col("n") > self._fanout ** (self._band * number)
                enters = enters & reaches
                foot = bands[number - 1].filter((F.col("level") == number * self._band) & reaches).withColumn("payload", F.lit(None).cast(payload))
            context = roots.filter(enters).select("tree", F.lit(0).cast("long").alias("block"), "siblings", "positions", "subroot", "root")
            if above is not None:
                context = context.unionByName(above.select("tree", self._block(number).alias("block"), "siblings", "positions", "subroot", "root"))
            if bands:
                nodes = bands[number].select("tree", self._block(number).alias("block"), "level", "lo", "hi", "digest")
                context = nodes.unionByName(context, allowMissingColumns=True)
            else:
                context = context.selectExpr("tree", "block", "int(null) level", "bigint(null) lo", "bigint(null) hi", "binary(null) digest", "siblings", "positions", "subroot", "root")
            met = foot.withColumn("block", self._block(number)).groupBy("tree", "block").cogroup(context.groupBy("tree", "block"))
            if checked and not number:
                return met.applyInArrow(_paths(0, True), f"payload {payload}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
            above = met.applyInArrow(_paths(number * self._band), f"tree string, n long, lo long, hi long, digest binary, payload {payload}, {_ABOVE}")
            if number:
                above = checkpointed(above)
        return above

    @cached_property
    def _group_roots(self) -> DataFrame:
        """Each group's root with its path to the root of all."""
        top_root = self._subroots(self._tops.drop("payload"), self._top_bands)
        start = top_root.select(
            "tree", F.lit(self._tops.agg(F.max("n")).first()[0]).cast("long").alias("n"), F.array().cast("array<binary>").alias("siblings"),
            F.array().cast("array<int>").alias("positions"), F.col("digest").alias("subroot"), F.col("digest").alias("root"),
        )
        tops = self._proved(self._tops, self._top_bands, start)
        sizes = self._leaves.filter("lo = 0").select("tree", F.col("n").alias("size"))
        return checkpointed(tops.select(F.col("payload").alias("tree"), "siblings", "positions", F.col("digest").alias("subroot"), "root").join(sizes, "tree").withColumnRenamed("size", "n"))

    def proofs(self) -> DataFrame:
        """Per leaf: ``payload``, ``leaf``, ``subroot``, ``root`` (hex), and the path: ``siblings`` per level (raw digests, left to right), ``positions`` among them."""
        proved = self._proved(self._leaves.drop("claim"), self._bands, self._group_roots)
        hexed = [F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
        return proved.select("payload", *hexed, "siblings", "positions")

    def checks(self) -> DataFrame:
        """Per leaf what its proof comes to: ``payload``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of all siblings of the path, in order) and
        ``folded_root``, which the claim, or else the leaf itself, leads to. Paths stay in the tasks."""
        return self._proved(self._leaves, self._bands, self._group_roots, True)
