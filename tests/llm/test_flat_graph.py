import math

import numpy as np
import pytest

from edge_cases import classes
from tallygrid.llm import flat_graph

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, node int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "s", None, "c") for i, v in rows], SCHEMA)


def valid(row):
    own, values = row
    return own is not None and values and all(x is not None and math.isfinite(x) for x in values) and any(values)


def slow(rows, threshold):
    """(vec_id, links, component) of every row."""
    points = {}
    for at, row in enumerate(rows):
        if valid(row):
            own = np.array(row[1], dtype=np.float32).astype(float)
            points[at] = own / np.linalg.norm(own)

    def linked(a, b):
        return a in points and b in points and len(points[a]) == len(points[b]) and float(points[a] @ points[b]) >= threshold

    places = range(len(rows))
    same = {at: at for at in places}
    first = {}
    for at in points:
        first.setdefault(rows[at][0], at)
    component = classes(same, lambda a, b: linked(a, b) or (a in points and b in points and rows[a][0] == rows[b][0]))
    least = {}
    for at in points:
        c = component[at]
        least[c] = min(least.get(c, rows[at][0]), rows[at][0])
    return [(rows[at][0], sum(linked(at, b) for b in places if b != at), least[component[at]] if at in points else rows[at][0]) for at in places]


def clustered(count, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, dims))
    return [(i * 3, ((middles[i % 11] if i % 11 < 8 else rng.normal(size=dims)) + rng.choice([0.0, 0.05, 0.2, 0.35]) * rng.normal(size=dims)).tolist()) for i in range(count)]


ODD = [
    (5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] + [1.0] * 15), (None, [1.0] * 16), (5005, [1.0, 2.0]),
    (5006, [2.0, 4.0]), (5007, [float("inf")] * 16), (5008, [3e38] * 16), (5009, [1e-38] * 16),
]


def check(spark, rows, threshold=0.9, **options):
    found = flat_graph.linked_vectors(vectors(spark, rows).repartition(3), threshold, **options).collect()
    assert sorted([tuple(r)[:3] for r in found], key=str) == sorted(slow(rows, threshold), key=str)
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in found)
    return found


def test_links_equal_brute_force(spark):
    rows = clustered(260)
    rows += ODD + [(7, rows[8][1]), (rows[1][0], rows[1][1]), (rows[2][0], rows[40][1])]
    found = check(spark, rows)
    assert {r.audited_recall for r in found} == {1.0}


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", 64)
    monkeypatch.setattr(flat_graph, "SAMPLE", 64)
    rows = clustered(400, seed=2)
    wanted = sum(r[1] for r in slow(rows, 0.9))
    found = flat_graph.linked_vectors(vectors(spark, rows), 0.9).collect()
    assert len(found) == len(rows)
    assert 0.95 * wanted <= sum(r.n_links for r in found) <= wanted
    assert found[0].audited_recall >= flat_graph.LEAST_RECALL


def test_copies_are_counted_and_not_expanded(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    found = check(spark, [(i, one) for i in range(50)] + [(100 + i, other) for i in range(3)])
    assert {r.n_links for r in found} == {49, 2}


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(4, [1.0, 2.0])])
    check(spark, ODD[:5])
    with pytest.raises(ValueError):
        flat_graph.linked_vectors(vectors(spark, []), 1.5)


def test_graph_is_pruned_and_reached_from_the_medoid():
    points = np.random.default_rng(3).normal(size=(300, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    links, medoid = flat_graph.flat_graph(points)
    seen, edge = {medoid}, [medoid]
    while edge:
        edge = [o for e in edge for o in links[e].tolist() if o not in seen and not seen.add(o)]
    assert seen == set(range(300))
    own = flat_graph.robust_pruned(points, 0, np.arange(1, 300))
    away = 1 - points @ points[0]
    assert own[0] == 1 + int(np.argmin(away[1:]))
    for place, kept in enumerate(own):
        assert all(flat_graph._ALPHA**2 * (1 - points[kept] @ points[e]) > away[kept] for e in own[:place])
