import random

import numpy as np
import pytest

from edge_cases import classes, edge_docs, edge_rows, no_docs
from tallygrid.llm import jaccard_join as jj
from tallygrid.llm.common import SLICE_BYTES
from tallygrid.llm.components import components
from tallygrid.llm.hashing import lower_ascii
from tallygrid.session import BATCH_BYTES


def shingle_set(text):
    words = lower_ascii((text or "").encode()).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def alike(a, b):
    common = len(a & b)
    return common > 0 and 100 * common >= 75 * (len(a) + len(b) - common)


def check(spark, rows, docs):
    found = sorted(tuple(r) for r in jj.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    least = classes(sets, alike)
    assert found == sorted((r[0], len(sets[r[0]]), least[r[0]]) for r in rows)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        place = rng.randrange(len(words))
        words[place : place + 1] = rng.choice([[], [f"n{rng.randrange(99)}"], [words[place], "more"]])
    return words


def test_families_of_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for size in (4, 5, 6, 8, 11, 15, 25, 40, 80, 300):
        origin = [f"v{rng.randrange(400)}" for _ in range(size)]
        for _ in range(12):
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rng, origin, rng.randrange(0, max(2, size // 12))) or ["x"])))
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_a_chain_of_links_is_one_class(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(12)]
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_edge_cases(spark):
    check(spark, edge_rows(), edge_docs(spark))


def test_no_documents_and_repeated_rows(spark):
    assert jj.similar_documents(no_docs(spark)).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jj.similar_documents(docs).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 20, 33, 70, 400])
def test_signatures_meet_for_every_similar_pair(n):
    """A set takes any H + 1 units; so of all sets within reach, each must share enough signatures."""
    rng = np.random.default_rng(n)
    one = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
    for _ in range(30):
        kept = one[rng.random(len(one)) > 0.12]
        new = np.unique(np.concatenate([kept, rng.integers(1, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        if not len(new) or not jj.similar(one, new):
            continue
        small, large = sorted((one, new), key=len)
        probe, flags, units = jj.signatures(large)
        indexed = set(jj.signatures(small)[0].tolist())
        common = np.array([s in indexed for s in probe.tolist()])
        sure = (flags & jj._SURE) > 0
        if sure.any() and not (flags & jj._PROBES).any():
            small_sure = set(jj.signatures(small)[0][(jj.signatures(small)[1] & jj._SURE) > 0].tolist())
            assert common[sure].any() or (set(probe.tolist()) & small_sure)
        else:
            usable = ((flags & jj._PROBES) > 0) & (((flags & jj._EMPTY) == 0) | ((flags & jj._LACKING) > 0))
            assert (usable & ~common).sum() <= jj.most_different(len(large)) and usable.sum() == units
            assert units >= jj.most_different(len(large)) + 1


def test_similarity_is_exact_at_the_bound():
    base = np.arange(8, dtype=np.uint64)
    assert jj.similar(base[:7], base[:6]) and jj.similar(base, base[:6]) and not jj.similar(base, base[:5])
    assert not jj.similar(base[:0], base[:0])


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    want = classes({x: {y for p in pairs if x in p for y in p} | {x} for p in pairs for x in p}, lambda a, b: bool(a & b))
    assert {n: c for n, c in want.items() if n in found} == found
    assert all(want[n] == n for n in want if n not in found)
    assert components(links.limit(0)).count() == 0


def test_a_leader_that_alone_looks_at_a_group_of_two_meets_the_other_member(spark):
    """Set 1 leads the group of signature 7 and is the only one to look at it; in group 8, of three, the leader is not the one that looks."""
    entry = lambda sig, doc, size: (jj._ENTRY_ROW, doc, sig, size)
    rows = [entry(7, 1, 2), entry(7, 2, 2), entry(8, 1, 3), entry(8, 3, 3), entry(8, 4, 3)]
    found = spark.createDataFrame(rows, "kind int, doc_id long, sig long, size int")
    chosen = spark.createDataFrame([(7, 1, False), (8, 3, False)], "sig long, s long, sure boolean")
    sets = spark.createDataFrame([(d, 10, 11, *[0] * jj._WORDS) for d in (1, 2, 3, 4)], "doc_id long, n int, units int, " + ", ".join(f"{k} long" for k in jj._SKETCH))
    pairs = jj._leader_pairs(found, chosen, jj._members(found, chosen), sets)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)]


def test_sets_of_shingles_that_no_other_component_holds_are_not_compared(spark, monkeypatch):
    """Near copies of one text and strays that differ from all by words of their own: after the first round, no pair is left to verify."""
    rng = random.Random(5)
    origin = [f"w{i}" for i in range(1500)]

    def changed(name, edits):
        words = list(origin)
        for place in rng.sample(range(1, 299), edits):
            words[place * 5] = f"{name}x{place}"
        return " ".join(words)

    rows = [(i, changed(f"n{i}", 3 if i < 30 else 60)) for i in range(42)]
    asked, links = [], jj._links
    monkeypatch.setattr(jj, "_links", lambda docs, pairs: asked.append(pairs.count()) or links(docs, pairs))
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert asked[0] >= 29 and sum(asked[1:]) == 0


def test_shingles_that_a_single_component_holds(spark):
    """Documents 1 and 2 are one component; 3 shares half of its shingles with them, and a row that repeats counts once."""
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g h i k", 3: "a b c d e f x y"}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    sets = {d: jj.shingles(t.encode()) for d, t in texts.items()}
    described = spark.createDataFrame([(d, len(v), len(v), *jj.sketch(v)) for d, v in sets.items()], "doc_id long, n int, units int, " + ", ".join(f"{k} long" for k in jj._SKETCH))
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "doc_id long, component long")
    assert jj._still_possible(docs, described, asked).count() == 0
    common = np.intersect1d(sets[1], sets[3])
    near = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "doc_id long, component long")
    found = {r["doc_id"]: r for r in jj._still_possible(docs, described, near).collect()}
    kept = np.intersect1d(sets[1], np.union1d(sets[2], sets[3]))
    assert len(common) == 2 and found[1]["shared"] == len(kept) == 5 and [found[1][k] for k in jj._SKETCH] == jj.sketch(kept)


def test_workers_get_texts_in_batches_of_a_slice(spark, monkeypatch):
    """Spark's limit of rows alone would send far more than a slice at once; the session's own setting stays."""
    before, seen = spark.conf.get(BATCH_BYTES, None), []
    real = jj._links
    monkeypatch.setattr(jj, "_links", lambda *args: seen.append(spark.conf.get(BATCH_BYTES).removesuffix("b")) or real(*args))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jj.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert set(seen) == {str(SLICE_BYTES)} and spark.conf.get(BATCH_BYTES, None) == before
