import itertools
import math
import random

import numpy as np
import pytest

from tallygrid.llm import decontaminate as dc
from tallygrid.llm import topk

SCHEMA = "vec_id long, embedding array<float>, block int, dims int, score long"


def vectors(count=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], 1, 2, 3) for i in range(count)]
    rows += [(1000 + i, rows[3][1], 1, 2, 3) for i in range(20)]  # ties
    rows += [
        (2000, None, 1, 2, 3), (2100, [], 1, 2, 3), (2200, [None, *rows[0][1][1:]], 1, 2, 3), (2300, [float("nan"), *rows[0][1][1:]], 1, 2, 3),
        (2400, [float("inf"), *rows[0][1][1:]], 1, 2, 3), (None, rows[0][1], 1, 2, 3), (2500, [1.0, 2.0], 1, 2, 3), (2600, [3.0, -2.0], 1, 2, 3),
        (2700, [0.0] * 8, 1, 2, 3), (100, rows[100][1], 1, 2, 3),
    ]
    return rows


def brute(rows, k):
    known = [(i, topk.whole_numbers(v)) for i, v, *_ in rows if i is not None]
    known = [(i, v) for i, v in known if v is not None]
    found = []
    for q, own in known:
        if q % 100 == 0:
            scores = sorted((-int(own @ v), i) for i, v in known if i != q and len(v) == len(own))
            found.append([(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])])
    return found


def test_search_equals_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    queries = frame.filter("vec_id % 100 = 0").dropDuplicates(["vec_id"])
    found = sorted(map(tuple, topk.search(frame, queries).collect()))
    want = sorted({r for group in brute(rows, 10) for r in group})
    assert found == want


def test_few_and_no_vectors(spark):
    rows = vectors()[:3]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert topk.search(frame, frame.filter("vec_id = 0")).count() == 2
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0


def test_the_index_stops_only_on_proof():
    rng = np.random.default_rng(3)
    for n in (1, 5, 11, 300):
        data = rng.integers(-2000, 2000, (n, 16))
        index = topk.ImpactIndex(np.arange(n), data)
        for query in (data[0], rng.integers(-2000, 2000, 16), np.zeros(16, dtype=np.int64)):
            ids, scores = index.search(query, 0, 10)
            want = sorted((-int(data[i] @ query), i) for i in range(n) if i != 0)[:10]
            assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want


def test_queries_meet_blocks_without_a_broadcast(spark, monkeypatch):
    """The copies of the queries for all blocks are no matter of the driver, however small the queries are."""
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(topk, "_BLOCK", 64)
    found = topk.search(frame, frame.filter("vec_id % 100 = 0").dropDuplicates(["vec_id"]))
    assert sorted(map(tuple, found.collect())) == sorted({r for group in brute(rows, 10) for r in group})
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held, tasks", [(1 << 22, ((1 << 22, 32),)), (64, ((1, 16),)), (1 << 22, ((100, 8), (200, 12))), (1, ((1, 20),))])
def test_any_grid_gives_the_same(spark, monkeypatch, held, tasks):
    rng = np.random.default_rng(6)
    rows = vectors(300) + [(5000 + 50 * i, [float(x) for x in (rng.normal(size=4) * 10.0**i).astype(np.float32)], 1, 2, 3) for i in range(6)] + [(200, vectors()[7][1], 1, 2, 3)]
    want = []
    known = [(i, topk.whole_numbers(v)) for i, v, *_ in rows if i is not None]
    known = [(i, v) for i, v in known if v is not None]
    for q in {i for i, _ in known if i % 100 == 0}:  # a repeated id asks once per row, and its answers are ranked together
        scores = sorted(x for i, own in known if i == q for x in sorted((-int(own @ v), j) for j, v in known if j != q and len(v) == len(own))[:10])
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:10])]
    for name, value in (("_BLOCK", 200), ("_BATCH", 16), ("_HELD", held), ("_TASKS", tasks)):
        monkeypatch.setattr(topk, name, value)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.search(frame, frame.filter("vec_id % 100 = 0")).collect())) == sorted(want)


def test_the_best_of_earlier_blocks_count(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk, "_RUN", 150)
    read = []
    monkeypatch.setattr(topk.ImpactIndex, "_read", lambda self, part, *rest, do=topk.ImpactIndex._read: (read.append(len(part)), do(self, part, *rest)))
    for dims, scale, same in ((1, 2**31 - 2000, 1), (16, 2**28, 1), (16, np.array([2000, 2000] + [3] * 14), 1), (16, 50, 40), (3, 1, 1)):
        n, none = 2000, np.zeros(0, dtype=np.int64)
        data = np.repeat((rng.uniform(-1, 1, (n // same, dims)) * scale).astype(np.int64), same, axis=0)
        queries, owners = np.concatenate([data[:4], data[-3:], np.zeros((1, dims), dtype=np.int64)]), np.array([0, 1, 2, 3, n - 3, n - 2, n - 1, -5])
        ids = rng.permutation(n)
        best = [(none, none)] * len(owners)
        segments = 0
        for a in range(0, n, 500):
            index = topk.ImpactIndex(ids[a : a + 500], data[a : a + 500])
            segments += len(index.dimension) * len(index.runs)
            best = index.improved(queries, owners, 10, best)
        for q, (found, scores) in enumerate(best):
            want = sorted((-int(data[i].astype(object) @ queries[q].astype(object)), int(ids[i])) for i in range(n) if ids[i] != owners[q])[:10]
            assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want
        if np.ndim(scale):  # two dimensions tell most, so the reading stops before the end
            assert sum(read) < segments
        read.clear()


def words(rng, count):
    return [f"t{rng.randrange(5000)}" for _ in range(count)]


def test_masks_find_two_replaced_tokens_wherever_they_are():
    rng = random.Random(2)
    item = words(rng, 18)
    index = dc._Index([(5, " ".join(item).encode())], dc.LEAST_TOKENS)
    for a in range(18):
        for b in range(a):
            changed = [f"new{i}" if i in (a, b) else w for i, w in enumerate(item)]
            text = " ".join(words(rng, 7) + changed + words(rng, 9)).encode()
            found = index.overlaps(dc.tokens(text))
            inner = a - b > 1 and b > 0 and a < 17
            assert found if inner or 16 - 1 >= dc.LEAST_TOKENS and a - b > 1 else True
            if inner:
                assert found == [(0, 7, 0, 18, 16)]


def needed(length):
    return min(dc.LEAST_TOKENS, max(dc.LEAST_ITEM, math.ceil(dc.AGREEMENT * length)))


def test_masks_hit_every_overlap_that_counts():
    """The most agreeing tokens of a stretch that no mask hits, by its length, are too few to count, also for an item of that length only."""
    span = max(map(len, dc.MASKS))
    missed = lambda bits: not any(len(m) <= len(bits) and all(b == "1" or c == "0" for b, c in zip(bits[-len(m):], m)) for m in dc.MASKS)
    most, states = [0], {"": 0}  # the last tokens of a stretch (1: agrees) to the most that agree
    for length in range(1, 65):
        grown = {}
        for bits, ones in states.items():
            for bit in "01":
                if missed(bits + bit) and not (bits + bit).endswith("00"):
                    key = (bits + bit)[-span:]
                    grown[key] = max(grown.get(key, 0), ones + int(bit))
        states = grown
        most.append(max(states.values()))
        assert length < dc.LEAST_ITEM or most[length] < max(needed(length), dc.AGREEMENT * length)
    # Longer stretches are parts of 16 tokens with 11 at most and a rest: each part loses one token against 75 %.
    assert most[16] <= 11 and max(most[r] - dc.AGREEMENT * r for r in range(16)) < 64 // 16


@pytest.mark.parametrize("length, replaced", [(10, 1), (12, 2), (12, 3), (15, 2), (16, 3), (16, 4), (17, 4), (20, 5)])
def test_lightly_edited_items_are_found(length, replaced):
    rng = random.Random(length)
    item = [f"i{i}" for i in range(length)]
    index = dc._Index([(5, " ".join(item).encode())], dc.LEAST_TOKENS)
    for places in itertools.combinations(range(1, length - 1), replaced):
        if any(b - a == 1 for a, b in zip(places, places[1:])):
            continue
        text = words(rng, 5) + [f"new{i}" if i in places else w for i, w in enumerate(item)] + words(rng, 5)
        assert index.overlaps(dc.tokens(" ".join(text).encode())) == [(0, 5, 0, length, length - replaced)]


def test_overlaps(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((30, 18, 9, 7, 400))] + [(9, None), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text = {i: t.split() for i, t in items if t}
    docs = [
        (1, " ".join(words(rng, 50) + [w.upper() + "," for w in text[0]] + words(rng, 5))),
        (2, " ".join(words(rng, 50) + text[0][:12])),
        (3, " ".join(text[4][100:140] + words(rng, 3) + text[4][200:230])),
        (4, " ".join(text[3] * 3)),
        (5, " ".join(text[2])),
        (6, None), (7, ""), (8, " ".join(words(rng, 3000))), (8, " ".join(words(rng, 30))), (None, " ".join(text[1])),
        (9, " ".join(text[0][:14] + ["other"] + text[0][15:])),
    ]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, slot int, item_id int")
    found = {r["doc_id"]: (r["items"], r["n_overlaps"], r["longest"]) for r in dc.contaminated(dc.overlaps(frame, benchmark)).collect()}
    assert found == {1: ([0], 1, 30), 3: ([4], 2, 40), 5: ([2], 1, 9), None: ([1], 1, 18), 9: ([0], 1, 29)}
    kept = dc.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 8]
    assert dc.overlaps(frame.limit(0), benchmark).count() == 0
    assert dc.overlaps(frame, benchmark.limit(0)).count() == 0
    assert dc.without_contaminated(frame, benchmark.limit(0)).count() == len(docs)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 20))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in items], "doc_id long, text string")
    want = sorted(map(tuple, dc.overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1)
    assert sorted(map(tuple, dc.overlaps(docs, benchmark).collect())) == want and len(want) == 6
    assert dc.without_contaminated(docs, benchmark).count() == 0


def test_components_that_overflow_scores_are_an_error():
    assert topk.whole_numbers([1e5, -1e5, 0.25]).tolist() == [102400000, -102400000, 256]
    with pytest.raises(ValueError):
        topk.whole_numbers([3e9, 1.0])
    assert topk.whole_numbers([float("inf"), 1.0]) is None
