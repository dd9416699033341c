"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Raking scales the cells until the token shares of every dimension meet their
targets. A scale for all cells then turns the weights into probabilities, so that the expected number of sampled tokens is the
wanted share of the input; a probability that would exceed 1 is 1, and the rest carries the difference. A document is sampled if a hash of its
id, taken as a number from 0 to 1, lies below the probability of its cell; ``weight`` is what a sampled document's tokens count.

All values of a dimension are told apart. Up to ``DRIVER_CELLS`` cells are raked in the driver; more stay a table, and only the
factors of one dimension at a time are computed anew and stored. If ``most_values`` is given, only that many values with the most
tokens and those that a target names are told apart, and all others share the value ``other`` (``other_`` if some value has that name).
Statistics cover all documents.

The topic stands in for a topic model: the vocabulary is dealt into eight fixed groups by hash, and a document belongs to the group that
most of its words of five or more bytes fall into (ties: the first group; none: topic ``none``). Tokens are words.

Nulls in a dimension are a value of their own. A null or empty text has no tokens; its document is sampled like the others of its
cell, and if no document has tokens, all probabilities are the wanted share. A target of a value that does not occur is spread
over the others. Documents with equal ids share their fate. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import new_work_dir
from .common import encoded
from .hashing import lower_ascii, word_hashes

DIMENSIONS = ("source", "lang", "topic")
OTHER = "other"
DRIVER_CELLS = 1 << 16
ROUNDS, TOLERANCE = 200, 1e-10
_SHORT = 5
_GROUP_BITS = 3
_UNIT = 1 << 53


def topic_and_tokens(text: bytes) -> tuple[str, int]:
    """The topic of a text and its number of words."""
    hashes, starts, ends = word_hashes(lower_ascii(text))
    long = hashes[ends - starts >= _SHORT]
    if not len(long):
        return "none", len(hashes)
    votes = np.bincount((long >> np.uint64(64 - _GROUP_BITS)).astype(np.int64), minlength=1 << _GROUP_BITS)
    return f"topic{int(votes.argmax())}", len(hashes)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [topic_and_tokens(text) for text in encoded(batch.column("text"))]
        topics, tokens = pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())
        kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), topics, tokens], names=[*(batch.schema.names[i] for i in kept), "topic", "n_tokens"])


def _profiled(rows: DataFrame, text_col: str) -> DataFrame:
    """Columns of ``rows`` but the text, with ``topic`` and ``n_tokens``."""
    own = rows.withColumn("text", F.col(text_col)) if text_col != "text" else rows
    schema = StructType([*(f for f in own.schema if f.name != "text"), StructField("topic", StringType()), StructField("n_tokens", LongType())])
    return own.mapInArrow(_profiles, schema)


def _named(value) -> str:
    return "\0" if value is None else value


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = TOLERANCE) -> np.ndarray:
    """The factor of each cell by which its tokens meet the target shares of every dimension.

    ``places``: per dimension, the value of each cell as a number; ``targets``: the share of each value.
    """
    mass = tokens.astype(np.float64)
    total = mass.sum()
    factor = np.ones(len(mass))
    if not total:
        return factor
    wanted = []
    for place, target in zip(places, targets):
        present = np.bincount(place, weights=mass, minlength=len(target)) > 0
        share = np.where(present, target, 0.0)
        wanted.append(share / share.sum() * total if share.sum() else np.bincount(place, weights=mass, minlength=len(target)))
    for _ in range(rounds):
        worst = 0.0
        for place, want in zip(places, wanted):
            have = np.bincount(place, weights=mass * factor, minlength=len(want))
            step = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(step[have > 0] - 1).max(initial=0.0)))
            factor *= step[place]
        if worst < tolerance:
            break
    return factor


def probabilities(tokens: np.ndarray, factor: np.ndarray, share: float) -> np.ndarray:
    """min(1, scale x factor) per cell, with the scale at which the expected tokens are ``share`` of all."""
    total = tokens.sum()
    if not total:
        return np.full(len(tokens), share)
    order = np.argsort(-factor, kind="stable")
    mass, own = tokens[order].astype(np.float64), factor[order]
    full = np.concatenate(([0.0], np.cumsum(mass)))
    rest = np.concatenate((np.cumsum((mass * own)[::-1])[::-1], [0.0]))
    scale = 1.0
    for sure in range(len(own)):  # the cells of largest factor are taken whole, one after the other
        if rest[sure] <= 0:
            break
        scale = (share * total - full[sure]) / rest[sure]
        if scale * own[sure] <= 1:
            break
    return np.clip(scale * factor, 0.0, 1.0)


def tempered(shares: dict, power: float) -> dict:
    """Shares raised to a power, adding up to 1: below 1, small values gain."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def _value_key(dimension: str):
    """A value as a string that is never null."""
    return F.when(F.col(dimension).isNull(), F.lit("0")).otherwise(F.concat(F.length(dimension).cast("string"), F.lit(":"), F.col(dimension)))


def rake_table(cells: DataFrame, targets: dict[str, dict], power: float, path: str) -> DataFrame:
    """:func:`rake` for cells that stay a table (``tokens``, and each dimension's value key): the cells with their ``factor``.

    The factor of a cell is the product of one factor per dimension. ``path``: where the factors of each step are stored.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("factor", F.lit(1.0))
    wanted, factors = {}, {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n"))
        if targets.get(d):
            named = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, share double")
            sums = sums.join(named.select(_value_key(d).alias(d), "share"), d, "left")
        else:
            sums = sums.withColumn("share", F.pow("n", F.lit(float(power))))
        sums = sums.select(d, "n", F.when(F.col("n") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
        shares = sums.agg(F.sum("share")).first()[0]
        sums.select(d, (F.col("share") / shares * total if shares else F.col("n")).alias("want"), F.lit(1.0).alias(f"f_{d}")).write.parquet(f"{path}/want-{d}")
        wanted[d] = spark.read.parquet(f"{path}/want-{d}").select(d, "want")
        factors[d] = spark.read.parquet(f"{path}/want-{d}").select(d, f"f_{d}")
    for number in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            others = [e for e in DIMENSIONS if e != d]
            joined = cells
            for e in others:
                joined = joined.join(factors[e], e)
            have = joined.groupBy(d).agg(F.sum(F.col("tokens") * F.col(f"f_{others[0]}") * F.col(f"f_{others[1]}")).alias("have"))
            old, has = F.col(f"f_{d}"), F.col("have") > 0
            step = have.join(wanted[d], d).join(factors[d], d).select(
                d, F.when(has, F.col("want") / F.col("have")).otherwise(old).alias(f"f_{d}"),
                F.when(has & (old > 0), F.abs(F.col("want") / F.col("have") / old - 1)).otherwise(0.0).alias("off"),
            )
            step.write.parquet(f"{path}/{number}-{d}")
            step = spark.read.parquet(f"{path}/{number}-{d}")
            worst = max(worst, step.agg(F.max("off")).first()[0] or 0.0)
            factors[d] = step.select(d, f"f_{d}")
        if worst < TOLERANCE:
            break
    for d in DIMENSIONS:
        cells = cells.join(factors[d], d)
    return cells.select(*DIMENSIONS, "tokens", (F.col("f_source") * F.col("f_lang") * F.col("f_topic")).alias("factor"))


def scale_of_table(raked: DataFrame, share: float) -> float:
    """The scale of :func:`probabilities` for cells that stay a table: cells once taken whole stay so, until none joins them."""
    total, scale, sure = raked.agg(F.sum("tokens")).first()[0], 0.0, -1
    while True:
        whole = F.col("factor") * scale > 1
        count, full, rest = raked.agg(F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("tokens") * F.col("factor")))).first()
        if count == sure or not rest:
            return scale or 1.0
        scale, sure = (share * total - (full or 0)) / rest, count


class Mix:
    """The cells of a corpus with their sampling probabilities, stored in the shared folder."""

    def __init__(self, docs: DataFrame, targets: dict[str, dict] | None = None, share: float = 0.5, power: float = 0.7, most_values: int | None = None, seed: int = 1, text_col: str = "text"):
        """``targets``: per dimension, the share of each value; by default the corpus's shares, raised to ``power``."""
        spark = docs.sparkSession
        self.seed, self.text_col = seed, text_col
        targets = targets or {}
        columns = [F.col(f"`{d}`").cast("string").alias(d) for d in DIMENSIONS if d != "topic"]
        found = _profiled(docs.select(*columns, F.col(f"`{text_col}`").alias("text")), "text")
        path = new_work_dir(spark, "mix")
        found.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).write.parquet(f"{path}/profile")
        profile = spark.read.parquet(f"{path}/profile")
        self.values: dict[str, list] = {}
        self.other: dict[str, str] = {}
        if most_values is not None:
            for dimension in DIMENSIONS:
                largest = profile.groupBy(dimension).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), dimension).limit(most_values).collect()
                self.values[dimension] = list(dict.fromkeys([*(r[dimension] for r in largest), *(targets.get(dimension) or {})]))
                taken = {r[0] for r in profile.filter(F.col(dimension).rlike(f"^{OTHER}_*$")).select(dimension).distinct().collect()}
                self.other[dimension] = next(name for name in (OTHER + "_" * i for i in range(len(taken) + 1)) if name not in taken)
        folded = profile.select(*(self._folded(d) for d in DIMENSIONS), "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
        if profile.count() <= DRIVER_CELLS:
            self._rake(spark, folded, targets, share, power).coalesce(1).write.parquet(f"{path}/cells")
        else:
            folded.select(*(_value_key(d).alias(d) for d in DIMENSIONS), "tokens").write.parquet(f"{path}/keyed")
            rake_table(spark.read.parquet(f"{path}/keyed"), targets, power, path).write.parquet(f"{path}/raked")
            raked = spark.read.parquet(f"{path}/raked")
            has = bool(raked.agg(F.sum("tokens")).first()[0])
            chosen = F.least(F.col("factor") * scale_of_table(raked, share), F.lit(1.0)) if has else F.lit(float(share))
            rows = raked.select(F.concat(*DIMENSIONS).alias("cell"), F.greatest(chosen, F.lit(0.0)).alias("probability"), "factor")
            weight = F.when(F.col("probability") > 0, F.col("factor") / F.col("probability")).otherwise(0.0)
            rows.select("cell", "probability", weight.alias("weight")).write.parquet(f"{path}/cells")
        self._cells = spark.read.parquet(f"{path}/cells")

    def _rake(self, spark, folded: DataFrame, targets: dict[str, dict], share: float, power: float) -> DataFrame:
        """The probabilities and weights of few cells."""
        cells = folded.orderBy(*DIMENSIONS).collect()
        tokens = np.array([r["tokens"] for r in cells], dtype=np.int64)
        places, wanted = [], []
        for dimension in DIMENSIONS:
            names = sorted({r[dimension] for r in cells}, key=_named)
            place_of = {name: i for i, name in enumerate(names)}
            place = np.array([place_of[r[dimension]] for r in cells], dtype=np.int64)
            have = np.bincount(place, weights=tokens, minlength=len(names)) if len(cells) else np.zeros(0)
            target = targets.get(dimension) or tempered(dict(zip(names, have)), power)
            places.append(place)
            wanted.append(np.array([target.get(name, 0.0) for name in names]))
        factor = rake(tokens, places, wanted, ROUNDS)
        probability = probabilities(tokens, factor, share)
        weight = np.divide(factor, probability, out=np.zeros_like(factor), where=probability > 0)
        rows = [(self._key_of(r), float(p), float(w)) for r, p, w in zip(cells, probability, weight)]
        return spark.createDataFrame(rows, "cell string, probability double, weight double")

    def _folded(self, dimension: str):
        value = F.col(dimension)
        if dimension not in self.values:
            return value
        known = [v for v in self.values[dimension] if v is not None]
        return F.when(value.isNull() | value.isin(known), value).otherwise(F.lit(self.other[dimension])).alias(dimension)

    @staticmethod
    def _key_of(row) -> str:
        return "".join("0" if row[d] is None else f"{len(row[d])}:{row[d]}" for d in DIMENSIONS)

    def _key(self):
        return F.concat(*(_value_key(d) for d in DIMENSIONS))

    def sample(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """The sampled rows: ``row`` (all their columns), ``source``, ``lang``, ``topic``, ``n_tokens``, ``probability``, ``weight``."""
        packed = docs.select(
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.lit(self.seed), F.col(f"`{id_col}`")).alias("place"),
            *(F.col(f"`{d}`").cast("string").alias(d) for d in DIMENSIONS if d != "topic"), F.col(f"`{self.text_col}`").alias("text"),
        )
        found = _profiled(packed, "text").select("row", "place", "n_tokens", *(self._folded(d) for d in DIMENSIONS)).withColumn("cell", self._key())
        drawn = F.pmod("place", F.lit(_UNIT)) / F.lit(float(_UNIT))
        return found.join(self._cells, "cell").filter(drawn < F.col("probability")).select("row", *DIMENSIONS, "n_tokens", "probability", "weight")
