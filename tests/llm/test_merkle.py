import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.llm import merkle, queries


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def slow_tree(digests, fanout):
    """The root, and per leaf the siblings of each level with the place among them."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(places):
            first = at - at % fanout
            paths[i].append((level[first:at], level[at + 1 : first + fanout]))
            places[i] = at // fanout
        level = [digest(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
    return level[0], paths


def slow_proofs(rows, fanout=2):
    """Of (group, order, leaf, name): name to leaf, root of the group, root, path."""
    groups = {}
    for group, order, leaf, name in rows:
        groups.setdefault(group, []).append((order is not None, order or 0, leaf, name))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = slow_tree([trees[g][0] for g in names], fanout) if names else (None, [])
    return {
        row[3]: (row[2], trees[g][0], root, path + over)
        for g, over in zip(names, above) for row, path in zip(sorted(groups[g]), trees[g][1])
    }


@pytest.mark.parametrize("fanout, band, size", [(2, 10, 300), (3, 2, 200), (2, 2, 64), (2, 10, 1), (4, 1, 0)])
def test_proofs_equal_brute_force(spark, fanout, band, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, "", "en", "en", "é", "zz"]), rng.choice([None, i, i]), digest(str(i)), i) for i in range(size)]
    leaves = spark.createDataFrame(rows, "group string, order long, digest string, payload long")
    manifest = merkle.Manifest(leaves, fanout, band)
    path = merkle.proof_digest(F.col("siblings"))
    folded = merkle.folded(F.col("leaf"), F.col("siblings"), F.col("positions"))
    got = {r[0]: tuple(r[1:]) for r in manifest.proofs().select("payload", "leaf", "subroot", "root", path.alias("p"), folded.alias("f")).collect()}
    wanted = slow_proofs(rows, fanout)
    assert got == {k: (a, s, r, digest(*[d for left, right in p for d in left + right]), r) for k, (a, s, r, p) in wanted.items()}
    nodes = manifest.nodes
    assert nodes.filter("lo >= hi or hi > n").count() == 0
    assert nodes.filter("level = 0").count() == size + len({r[0] for r in rows})


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, "s", "ü"]), rng.choice(["en", "de", None, ""]), rng.choice([None, i, -1]), rng.choice([None, "", "text é " * rng.randrange(1, 50)]), 1, "x")
        for i in range(150)
    ]
    rows += [(None, None, None, None, None, 2, None), (151, "s", "fr", 9, "long " * 50_000, 1, "y"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, level int, digest string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    leaves = [(r[2], r[0], digest(*map(value, r[:5])), i) for i, r in enumerate(rows)]
    wanted = []
    for i, (leaf, subroot, root, path) in slow_proofs(leaves).items():
        row = rows[i]
        start = leaf
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
            start = digest(*map(value, (*row[:3], row[3] + 1, row[4])))
        end = start
        for left, right in path:
            end = digest(*left, end, *right)
        wanted.append((row[0], leaf, subroot, root, digest(*[d for left, right in path for d in left + right]), end, end == root))
    got = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert tuples(got) == sorted(wanted, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert 0 < sum(not r[-1] for r in wanted) < len(rows) / 3


def test_bad_shapes_are_refused(spark):
    leaves = spark.createDataFrame([], "group string, order long, digest string, payload long")
    with pytest.raises(ValueError):
        merkle.Manifest(leaves, fanout=1)
