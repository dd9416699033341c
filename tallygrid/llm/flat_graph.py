"""Near-duplicate vectors through a flat, robust-pruned proximity graph.

1. Equal vectors are folded into one node with a count. Nodes are sorted into shards by a tree of cluster centres; centres are fitted on a bounded sample of
   each shard that is too large (``SAMPLE`` vectors), until every shard holds about ``SHARD`` vectors. Every node goes to the two shards
   whose centres are nearest, so neighbouring shards overlap. The nearest one is its home.
2. In its home shard, a node that is within an angle of less than half the threshold's of another joins its ball. All members of a ball are linked by
   the triangle inequality, so a dense group costs one node of the graph and not a link per pair. Most balls hold a single node.
3. Per shard, the centres of balls become a graph: each keeps the nearest of its candidates that no kept one already leads to (robust pruning), back links
   are pruned likewise, and what the medoid does not reach is hung on its nearest reached neighbour.
4. The lists of a ball from all its shards are united. Each ball then searches its home shard: greedily from the shard's medoid and from itself, keeping the best
   ``beam`` candidates open and expanding everything in range, however much that is. What it finds that is at home elsewhere
   makes it search there too, in the next round, until nobody has anything left to ask.
5. Balls in range are compared: by their radii both are linked as a whole or not at all, or else their members are compared one by one, in double precision.
6. An audit compares a bounded random sample of vectors (``AUDIT``) with all others; if fewer than ``LEAST_RECALL`` of their links were found, all is done again with a
   beam twice as wide and one more shard per vector.

Links are counted, not listed: a count per vector and one edge per pair of balls leave the tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; neither do vectors of different lengths with each
other. A row without an id takes no part and comes back with null as its component, kept. Rows that repeat an id are vectors of their own, but
as one id they are in one component; of them all with ``vec_id = component_id`` are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, new_work_dir, ship
from .components import components

SHARD = 2048
SAMPLE = 2048
BEAM = 16
AUDIT = 256
LEAST_RECALL = 0.95
#: Links that a ball keeps, candidates for them, and how much nearer a kept link must lead for another to be left out.
_DEGREE = 24
_CANDIDATES = 64
_ALPHA = 1.2
#: Share of the threshold's angle within which a ball's members lie around its centre; below a half, so all are linked.
_BALL = 0.485
_BRANCHES = 64
_DEEPEST = 12
_CHUNK = 1024
_ROWS = 4096
_CLOSE = 1e-7


def units(blobs: list[bytes]) -> np.ndarray:
    """Raw little-endian doubles as vectors of length 1. They are scaled by powers of two first, so no square overflows."""
    raw = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with the bytes of the vectors that take part, and a digest of them."""
    for batch in batches:
        column = batch.column("vector")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(column.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        ids, blobs = batch.column("vec_id"), []
        for row, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            own = flat[end - size : end]
            blobs.append(own.astype("<f8").tobytes() if size and ids[row].is_valid and np.isfinite(own).all() and own.any() else None)
        digests = [None if b is None else hashlib.sha256(b).digest() for b in blobs]
        yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "digest", "vector"])


def _centres(key, group):
    """Cluster centres of a sample: a few rounds of assigning and averaging."""
    at, size = group["shard"][0].as_py(), group["size"][0].as_py()
    points = units(group.sort_by("node")["vector"].to_pylist())
    count = min(_BRANCHES, max(2, -(-size // (SHARD // 2))), len(points))
    centres = points[:: max(1, len(points) // count)][:count].copy()
    for _ in range(4):
        nearest = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            own = points[nearest == c].sum(axis=0)
            length = np.sqrt(own @ own)
            if length > 0:
                centres[c] = own / length
    return pa.table({"shard": [at], "centres": pa.array([centres.astype("<f8").tobytes()], pa.binary())})


def _dealt(overlap: int):
    def run(key, rows, centres):
        if not rows.num_rows or not centres.num_rows:
            return _no_rows()
        points = units(rows["vector"].to_pylist())
        middle = np.frombuffer(centres["centres"][0].as_py(), dtype="<f8").reshape(-1, points.shape[1])
        near = points @ middle.T
        count = min(overlap, len(middle))
        best = np.argsort(-near, axis=1, kind="stable")[:, :count]
        at = rows["shard"][0].as_py()
        index = np.repeat(np.arange(len(points)), count)
        taken = rows.take(pa.array(index))
        return pa.table({
            **{c: taken[c] for c in ("node", "rep", "copies", "vector")},
            "shard": pa.array([f"{at}.{c}" for c in best.ravel().tolist()]),
            "distance": pa.array(1.0 - np.take_along_axis(near, best, axis=1).ravel()),
        })

    return run


_STATE = "node long, rep long, copies long, vector binary, shard string, distance double"


def _no_rows() -> pa.Table:
    return pa.table({
        "node": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "vector": pa.array([], pa.binary()),
        "shard": pa.array([], pa.string()), "distance": pa.array([], pa.float64()),
    })


def _sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """Nodes with the ``overlap`` shards of the nearest centres, nearest first: a search of that width through the tree of centres."""
    state = nodes.withColumn("shard", (F.octet_length("vector") / 8).cast("int").cast("string")).withColumn("distance", F.lit(0.0))
    for _ in range(_DEEPEST):
        sizes = state.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SHARD)
        if sizes.isEmpty():
            break
        sized = state.join(sizes, "shard", "left")
        large = sized.filter("size is not null")
        chance = F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 40)) < F.ceil(F.lit(SAMPLE << 40) / F.col("size"))
        centres = large.filter(chance).groupBy("shard").applyInArrow(_centres, "shard string, centres binary")
        salts = F.ceil(F.col("size") / _ROWS)
        rows = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts)).drop("size")
        spread = centres.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("size")
        dealt = rows.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(_dealt(overlap), _STATE)
        both = dealt.unionByName(sized.filter("size is null").drop("size"))
        state = checkpointed(_best(both, overlap).select("node", "rep", "copies", "vector", F.inline("places")).select("node", "rep", "copies", "vector", "shard", "distance"))
    return _best(state, overlap).withColumn("shards", F.col("places.shard")).drop("places")


def _best(state: DataFrame, overlap: int) -> DataFrame:
    places = F.slice(F.array_sort(F.collect_set(F.struct("distance", "shard"))), 1, overlap)
    return state.groupBy("node").agg(F.first("rep").alias("rep"), F.first("copies").alias("copies"), F.first("vector").alias("vector"), places.alias("places"))


_MEMBERS = "node long, rep long, copies long, vector binary, shards array<string>, ball long, radius double, weight long, size long"


def _balls(reach: float):
    """Put the nodes of a shard into balls: the node with most nodes around it first, then what is left."""
    near = math.cos(reach)

    def run(key, group):
        group = group.sort_by("node")
        points = units(group["vector"].to_pylist())
        count = len(points)
        around = np.concatenate([(points[a : a + _ROWS] @ points.T >= near).sum(axis=1) for a in range(0, count, _ROWS)])
        ball, radius = np.full(count, -1), np.zeros(count)
        for centre in np.argsort(-around, kind="stable").tolist():
            if ball[centre] >= 0:
                continue
            if around[centre] == 1:
                ball[centre] = centre
                continue
            free = np.flatnonzero(ball < 0)
            cosine = points[free] @ points[centre]
            own = (cosine >= near) | (free == centre)
            ball[free[own]] = centre
            radius[centre] = math.acos(min(1.0, max(-1.0, float(cosine[own].min()))))
        copies = group["copies"].to_numpy()
        weight = np.bincount(ball, weights=copies, minlength=count).astype(np.int64)
        size = np.bincount(ball, minlength=count)
        nodes = group["node"].to_numpy()
        return pa.table({
            **{c: group[c] for c in ("node", "rep", "copies", "vector", "shards")},
            "ball": pa.array(nodes[ball]), "radius": pa.array(radius[ball]), "weight": pa.array(weight[ball]), "size": pa.array(size[ball], pa.int64()),
        })

    return run


def robust_pruned(points: np.ndarray, own: int, candidates: np.ndarray, degree: int = _DEGREE, alpha: float = _ALPHA) -> np.ndarray:
    """The links of a point: the nearest candidates, without those that a kept one is ``alpha`` times nearer to than the point itself."""
    away = 1.0 - points[candidates] @ points[own]
    order = np.argsort(away, kind="stable")
    left, away = candidates[order], away[order]
    kept: list[int] = []
    while len(left) and len(kept) < degree:
        nearest = left[0]
        kept.append(int(nearest))
        between = 1.0 - points[left] @ points[nearest]
        # Distances are chords, whose squares are twice 1 - cosine.
        open_ = between * (alpha * alpha) > away
        open_[0] = False
        left, away = left[open_], away[open_]
    return np.array(kept, dtype=np.int64)


def flat_graph(points: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Links of every point, and the medoid, from which every point can be reached."""
    count = len(points)
    middle = points.sum(axis=0)
    medoid = int(np.argmax(points @ middle))
    if count == 1:
        return [np.zeros(0, dtype=np.int64)], medoid
    links: list[np.ndarray] = []
    wide = min(_CANDIDATES, count - 1)
    mixed = np.random.default_rng(count).permutation(count)
    for a in range(0, count, 1024):
        near = points[a : a + 1024] @ points.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2.0
        best = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        for row, found in enumerate(best):
            far = mixed[(np.arange(4) * 7919 + a + row) % count]
            pool = np.unique(np.append(found, far[far != a + row]))
            links.append(robust_pruned(points, a + row, pool))
    back: list[list[int]] = [[] for _ in range(count)]
    for own, found in enumerate(links):
        for other in found.tolist():
            back[other].append(own)
    for own, more in enumerate(back):
        both = np.union1d(links[own], np.array(more, dtype=np.int64))
        links[own] = both if len(both) <= _DEGREE else robust_pruned(points, own, both)
    reached = np.zeros(count, dtype=bool)
    reached[medoid] = True
    edge = [medoid]
    while True:
        while edge:
            found = np.concatenate([links[e] for e in edge])
            found = np.unique(found[~reached[found]])
            reached[found] = True
            edge = found.tolist()
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return links, medoid
        inside = np.flatnonzero(reached)
        near = points[lost[0]] @ points[inside].T
        host = int(inside[np.argmax(near)])
        links[host] = np.append(links[host], lost[0])
        reached[lost[0]] = True
        edge = [int(lost[0])]


def _linked(key, group):
    group = group.sort_by("ball")
    points = units(group["vector"].to_pylist())
    balls = group["ball"].to_numpy()
    links, medoid = flat_graph(points)
    starts = np.zeros(len(balls), dtype=bool)
    starts[medoid] = True
    return pa.table({
        **{c: group[c] for c in ("ball", "vector", "radius", "weight", "size", "home", "shard")},
        "medoid": pa.array(starts), "links": pa.array([balls[x].astype("<i8").tobytes() for x in links], pa.binary()),
    })


_GRAPH = "ball long, vector binary, radius double, weight long, size long, home string, shard string, medoid boolean, links binary"
_FOUND = "a long, b long, cosine double, radius_a double, radius_b double, weight_a long, weight_b long, size_a long, size_b long, asks long, shard string"


def _in_range(threshold: float, beam: int):
    """Search a shard for all queries at home there, or for those that ask from elsewhere."""
    reach = math.acos(threshold)

    def run(key, graph, asked):
        graph = graph.sort_by("ball")
        here = graph["shard"][0].as_py() if graph.num_rows else None
        balls = graph["ball"].to_numpy()
        place = {b: i for i, b in enumerate(balls.tolist())}
        points = units(graph["vector"].to_pylist())
        radius, weight, size = (graph[c].to_numpy() for c in ("radius", "weight", "size"))
        homes = graph["home"].to_pylist()
        links = []
        for lists in graph["links"].to_pylist():
            found = np.unique(np.concatenate([np.frombuffer(x, dtype="<i8") for x in lists]))
            links.append(np.array([place[b] for b in found.tolist() if b in place], dtype=np.int64))
        medoids = np.flatnonzero(np.array([here in x for x in graph["medoids"].to_pylist()])).tolist()
        if asked is None:
            queries = [(b, points[i], radius[i], weight[i], size[i], [i]) for i, b in enumerate(balls.tolist()) if homes[i] == here]
        else:
            own = units(asked["vector"].to_pylist())
            starts = [[place[s] for s in x if s in place] for x in asked["starts"].to_pylist()]
            queries = list(zip(asked["ball"].to_pylist(), own, asked["radius"].to_pylist(), asked["weight"].to_pylist(), asked["size"].to_pylist(), starts))
        pairs: list[tuple] = []
        requests: list[tuple] = []
        for ball, point, own_radius, own_weight, own_size, starts in queries:
            least = np.cos(np.minimum(math.pi, reach + own_radius + radius)) - _CLOSE
            seen = np.zeros(len(balls), dtype=bool)
            open_: list[tuple[float, int]] = []
            best: list[float] = []
            fresh = np.unique(np.array([*medoids, *starts], dtype=np.int64))
            hits: list[tuple[int, float]] = []
            while True:
                seen[fresh] = True
                cosines = points[fresh] @ point
                inside = cosines >= least[fresh]
                hits += zip(fresh[inside].tolist(), cosines[inside].tolist())
                for node, cosine, hit in zip(fresh.tolist(), cosines.tolist(), inside.tolist()):
                    if len(best) < beam:
                        heapq.heappush(best, cosine)
                    elif cosine > best[0]:
                        heapq.heapreplace(best, cosine)
                    elif not hit:
                        continue
                    # What is in range is always expanded, the rest while it is among the best.
                    heapq.heappush(open_, (-2.0 - cosine if hit else -cosine, node))
                fresh = None
                while open_:
                    score, node = heapq.heappop(open_)
                    if score > -1.0 and -score < best[0]:
                        open_ = []
                        break
                    found = links[node]
                    found = found[~seen[found]]
                    if len(found):
                        fresh = found
                        break
                if fresh is None:
                    break
            for node, cosine in hits:
                other = int(balls[node])
                if other == ball:
                    continue
                if homes[node] != here:
                    requests.append((ball, other, homes[node]))
                pair = [(ball, own_radius, own_weight, own_size), (other, float(radius[node]), int(weight[node]), int(size[node]))]
                (a, ra, wa, sa), (b, rb, wb, sb) = sorted(pair)
                pairs.append((a, b, cosine, ra, rb, wa, wb, sa, sb, None, None))
        rows = pairs + [(q, o, None, None, None, None, None, None, None, q, h) for q, o, h in requests]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *[pa.int64()] * 5, pa.string()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _found_pairs(graph: DataFrame, leaders: DataFrame, threshold: float, beam: int) -> DataFrame:
    """Every pair of balls that a search has brought together, once."""
    spark = graph.sparkSession
    folder = new_work_dir(spark, "flat-graph")
    united = graph.groupBy("ball").agg(
        *[F.first(c).alias(c) for c in ("vector", "radius", "weight", "size", "home")], F.collect_list("links").alias("links"),
        F.collect_list("shard").alias("_shards"), F.collect_list(F.when(F.col("medoid"), F.col("shard"))).alias("medoids"),
    )
    united.withColumn("shard", F.explode("_shards")).drop("_shards").write.parquet(f"{folder}/graph")
    stored = spark.read.parquet(f"{folder}/graph")
    search = _in_range(threshold, beam)

    def at_home(key, shard):
        return search(key, shard, None)

    rounds = 0
    stored.groupBy("shard").applyInArrow(at_home, _FOUND).write.parquet(f"{folder}/round-0")
    found = spark.read.parquet(f"{folder}/round-0")
    asked = found.filter("asks is not null")
    # Pairs are searched for once per ball and shard.
    known = asked.limit(0).select(F.col("asks").alias("ball"), "shard")
    pairs = found.filter("asks is null")
    while not asked.isEmpty():
        requests = asked.groupBy(F.col("asks").alias("ball"), "shard").agg(F.collect_set("b").alias("starts"))
        if rounds:
            requests = requests.join(known, ["ball", "shard"], "left_anti")
        requests.write.parquet(f"{folder}/asked-{rounds}")
        requests = spark.read.parquet(f"{folder}/asked-{rounds}")
        known = known.unionByName(requests.select("ball", "shard"))
        rounds += 1
        wanted = stored.join(requests.select("shard").distinct(), "shard", "left_semi")
        of_query = requests.join(leaders.select("ball", "vector", "radius", "weight", "size"), "ball")

        def met(key, shard, queries):
            return search(key, shard, queries)

        wanted.groupBy("shard").cogroup(of_query.groupBy("shard")).applyInArrow(met, _FOUND).write.parquet(f"{folder}/round-{rounds}")
        found = spark.read.parquet(f"{folder}/round-{rounds}")
        pairs = pairs.unionByName(found.filter("asks is null"))
        asked = found.filter("asks is not null").join(known, (F.col("asks") == known["ball"]) & (found["shard"] == known["shard"]), "left_anti")
    rest = [F.first(c).alias(c) for c in pairs.columns if c not in ("a", "b", "cosine", "asks", "shard")]
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), *rest)


def _compared(threshold: float):
    """Count the links between the members of two chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, links, pairs = [], [], []
            for row in batch.to_pylist():
                left, right = (units([m["vector"] for m in row[s]]) for s in ("left", "right"))
                linked = left @ right.T >= threshold
                if linked.any():
                    pairs.append((row["a"], row["b"]))
                for side, hits, others in (("left", linked, "right"), ("right", linked.T, "left")):
                    counts = hits @ np.array([m["copies"] for m in row[others]], dtype=np.int64)
                    some = np.flatnonzero(counts)
                    nodes += [row[side][i]["node"] for i in some.tolist()]
                    links += counts[some].tolist()
            size = len(nodes) + len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes + [None] * len(pairs), pa.int64()), pa.array(links + [None] * len(pairs), pa.int64()),
                 pa.array([None] * len(nodes) + [p[0] for p in pairs], pa.int64()), pa.array([None] * len(nodes) + [p[1] for p in pairs], pa.int64())],
                names=["node", "links", "a", "b"],
            ) if size else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["node", "links", "a", "b"])

    return run


def _links(members: DataFrame, threshold: float, beam: int) -> tuple[DataFrame, DataFrame]:
    """Links of every node (``node``, ``n_links``), and the pairs of balls that hold a link (``a``, ``b``)."""
    spark = members.sparkSession
    leaders = members.filter("node = ball").withColumn("home", F.element_at("shards", 1))
    graph = leaders.withColumn("shard", F.explode("shards")).select("ball", "vector", "radius", "weight", "size", "home", "shard")
    pairs = checkpointed(_found_pairs(graph.groupBy("shard").applyInArrow(_linked, _GRAPH), leaders, threshold, beam))
    reach = math.acos(threshold)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    single = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    wholly = F.when(single, F.col("cosine") >= threshold).otherwise(angle + F.col("radius_a") + F.col("radius_b") <= reach - _CLOSE)
    whole = pairs.filter(wholly)
    of_ball = whole.select(F.inline(F.array(
        F.struct(F.col("a").alias("ball"), F.col("weight_b").alias("links")), F.struct(F.col("b").alias("ball"), F.col("weight_a").alias("links"))
    ))).groupBy("ball").agg(F.sum("links").alias("by_ball"))
    # Members travel in chunks, so a task compares a bounded number of them at a time, whatever the size of the balls.
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / _CHUNK))
    chunks = members.groupBy("ball", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "copies", "vector")).alias("members")).drop("chunk")
    doubtful = pairs.filter(~wholly & ~single).select("a", "b")
    sides = doubtful.join(chunks.select(F.col("ball").alias("a"), F.col("members").alias("left")), "a").join(
        chunks.select(F.col("ball").alias("b"), F.col("members").alias("right")), "b"
    ).select("a", "b", "left", "right")
    folder = new_work_dir(spark, "flat-graph")
    sides.mapInArrow(_compared(threshold), "node long, links long, a long, b long").write.parquet(folder)
    compared = spark.read.parquet(folder)
    of_node = compared.filter("node is not null").groupBy("node").agg(F.sum("links").alias("by_node"))
    counted = members.join(of_ball, "ball", "left").join(of_node, "node", "left").select(
        "node", "ball", "rep", "copies", (F.col("weight") - 1 + F.coalesce("by_ball", F.lit(0)) + F.coalesce("by_node", F.lit(0))).alias("n_links")
    )
    edges = whole.select("a", "b").unionByName(compared.filter("node is null").select("a", "b").distinct())
    return counted, edges


def _audited(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """The share of all links of a bounded random sample of nodes that were found."""
    total = counted.count()
    if not total:
        return 1.0
    chance = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 30)) < F.lit(math.ceil(AUDIT * (1 << 30) / total))
    asked = nodes.filter(chance).join(counted.select("node", "n_links"), "node").select("node", "vector", "n_links").limit(2 * AUDIT).collect()
    groups: dict[int, list] = {}
    for row in asked:
        groups.setdefault(len(row["vector"]), []).append(row)
    probes = {size: ([r["node"] for r in own], units([bytes(r["vector"]) for r in own])) for size, own in groups.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            vectors, copies = batch.column("vector").to_pylist(), batch.column("copies").to_numpy()
            sizes = np.array([len(v) for v in vectors])
            for size, (names, points) in probes.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    hits = (points @ units([vectors[i] for i in at.tolist()]).T >= threshold) @ copies[at]
                    for name, hit in zip(names, hits.tolist()):
                        totals[name] = totals.get(name, 0) + hit
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int64()), pa.array(totals.values(), pa.int64())], names=["node", "links"])

    true = {r["node"]: r["links"] for r in nodes.select("vector", "copies").mapInArrow(scan, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()}
    every = sum(true[r["node"]] - 1 for r in asked)
    return sum(min(r["n_links"], true[r["node"]] - 1) for r in asked) / every if every else 1.0


def linked_vectors(vectors: DataFrame, threshold: float = 0.9, beam: int = BEAM, overlap: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``, ``audited_recall`` (of the whole run)."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("the threshold is a cosine between 0 and 1")
    ship(vectors.sparkSession)
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = own.mapInArrow(_read, "vec_id long, digest binary, vector binary")
    folded = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    nodes = checkpointed(folded.withColumn("node", F.monotonically_increasing_id()))
    reach = _BALL * math.acos(threshold)
    while True:
        sharded = _sharded(nodes.select("node", "rep", "copies", "vector"), overlap)
        members = checkpointed(sharded.withColumn("home", F.element_at("shards", 1)).groupBy("home").applyInArrow(_balls(reach), _MEMBERS))
        counted, edges = _links(members, threshold, beam)
        counted = checkpointed(counted)
        recall = _audited(nodes, counted, threshold)
        if recall >= LEAST_RECALL or beam >= 64 * BEAM:
            break
        beam, overlap = 2 * beam, overlap + 1
    edges = edges.unionByName(_tied(rows, nodes, counted))
    named = _components(counted, edges)
    of_node = counted.join(named, "ball").join(nodes.select("node", "digest"), "node").select("digest", "n_links", "component_id")
    result = rows.select("vec_id", "digest").join(of_node, "digest", "left")
    component: Column = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"),
    )


def _tied(rows: DataFrame, nodes: DataFrame, counted: DataFrame) -> DataFrame:
    """Pairs of balls that share an id, since rows of one id are one vertex: the least ball of the id with each of its others."""
    valid = rows.filter("digest is not null")
    repeated = valid.groupBy("vec_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last").select("vec_id")
    placed = valid.join(repeated, "vec_id", "left_semi").join(nodes.select("node", "digest"), "digest").join(counted.select("node", "ball"), "node")
    balls = placed.select("vec_id", "ball").distinct()
    return balls.groupBy("vec_id").agg(F.min("ball").alias("a")).join(balls.withColumnRenamed("ball", "b"), "vec_id").filter("a <> b").select("a", "b")


def _components(counted: DataFrame, edges: DataFrame) -> DataFrame:
    """The least id in the component of each ball: ``ball``, ``component_id``."""
    named = components(edges).select(F.col("node").alias("ball"), "component")
    least = counted.groupBy("ball").agg(F.min("rep").alias("least")).join(named, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    return least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("ball", "component_id")
