import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from edge_cases import edge_rows, no_docs
from tallygrid.llm import periodic_runs, queries

COLUMNS = "doc_id long, text string, lang string, runs int, n_words int, vector string"


def slow_runs(words, least=6, exponent=4):
    """Every maximal stretch of equal words a fixed distance apart, without those that a shorter distance explains."""
    size, found = len(words), []
    for period in range(1, size // exponent + 1):
        i = 0
        while i + period < size:
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < size and words[i] == words[i + period]:
                i += 1
            length = i + period - start
            if length >= max(least, exponent * period) and not any(
                all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, period)
            ):
                found.append((start, length, period))
    return sorted(found)


def random_sequence(rng):
    size, letters = rng.randrange(1, 70), rng.choice([1, 2, 2, 3, 6])
    own = [rng.randrange(letters) for _ in range(size)]
    if rng.random() < 0.6:
        start, period = rng.randrange(size), 1 + rng.randrange(9)
        own = [own[min(size - 1, start + (i - start) % period)] if i > start else x for i, x in enumerate(own)]
    return own


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        own = random_sequence(rng)
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            assert [tuple(r) for r in periodic_runs.runs(np.array(own), least, exponent).tolist()] == slow_runs(own, least, exponent)


def test_stretches_hold_every_run_whole():
    rng = random.Random(5)
    for _ in range(200):
        texts = [random_sequence(rng) for _ in range(4)]
        codes, owner = np.concatenate([np.array(t) for t in texts]), np.repeat(np.arange(4), [len(t) for t in texts])
        before = np.cumsum([0, *map(len, texts)])
        for least, exponent in ((6, 4), (2, 2)):
            found = [set() for _ in texts]
            for a, b in zip(*periodic_runs.stretches(codes, owner, least, exponent)):
                for start, length, period in periodic_runs.runs(codes[a:b], least, exponent).tolist():
                    found[owner[a]].add((start + int(a - before[owner[a]]), length, period))
            assert [sorted(f) for f in found] == [slow_runs(t, least, exponent) for t in texts]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    size, g = len(words), h // 10
    if h % 10 == 0 and size:
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in edge_rows(count=60)]
    rows += [(1000 + i, " ".join(f"w{x}" for x in random_sequence(rng))) for i in range(60)]
    rows += [(None, "a b " * 9), (2000, "x " * 3000), (2000, "x " * 3000), (2001, " ".join(str(i % 331) for i in range(2000))), (2002, "a\x1cb a\x1cb\u00a0" * 8)]
    docs = spark.createDataFrame([(i, t, None, 1, 2, "v") for i, t in rows], COLUMNS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: str(r)
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sum(r[1] for r in got) > 20


def test_real_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "say la la la la la la  la now")], "doc_id long, text string")
    row = periodic_runs.without_repetitions(docs).first()
    assert (row.n_words, row.collapsed, [tuple(r) for r in row.runs]) == (9, "say la now", [(1, 7, 1)])
    assert periodic_runs.without_repetitions(no_docs(spark)).count() == 0
