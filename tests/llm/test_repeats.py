import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import edge_docs, edge_rows, no_docs, without_windows
from tallygrid.llm import substring_dedup, suffix_dedup
from tallygrid.llm.anchors import anchors
from tallygrid.llm.hashing import Runs, byte_symbols, window_minima, word_hashes
from tallygrid.llm.suffix_groups import END, GUARD, suffix_arrays


def test_word_hashes_split_at_ascii_white_space_only():
    text = "a b\tb\x0b a  ü\x1f a".encode()
    hashes, starts, ends = word_hashes(text)
    words = text.split()
    assert [text[a:b] for a, b in zip(starts, ends)] == words
    assert [[h == g for g in hashes] for h in hashes] == [[w == v for v in words] for w in words]


def test_run_hashes_and_minima():
    rng = random.Random(1)
    symbols = byte_symbols(bytes(rng.choice(b"ab") for _ in range(200)))
    runs = Runs(symbols).all(7)
    raw = [symbols[i : i + 7].tobytes() for i in range(194)]
    assert all((runs[i] == runs[j]) == (raw[i] == raw[j]) for i in range(194) for j in range(194))
    assert (Runs(symbols).at(np.array([3, 50]), 7) == runs[[3, 50]]).all()
    values = np.array([rng.randrange(1 << 63) for _ in range(100)], dtype=np.uint64)
    assert window_minima(values, 13).tolist() == [i + int(np.argmin(values[i : i + 13] >> np.uint64(24))) for i in range(88)]
    assert len(Runs(symbols[:3]).all(7)) == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abc") for _ in range(150))
    texts = [bytes(rng.choice(b"abc") for _ in range(80)) + shared + bytes(rng.choice(b"abc") for _ in range(80)) for _ in range(2)]
    seen = []
    for text in texts:
        anchor, whole, first, last = anchors(byte_symbols(text), 50, 20)
        assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
        seen.append({text[w : w + 50]: int(a) for a, f, e in zip(anchor, first, last) for w in range(f, e + 1)})
    common = seen[0].keys() & seen[1].keys()
    assert len(common) >= 101 and all(seen[0][w] == seen[1][w] for w in common)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_arrays_of_many_texts(letters):
    rng = random.Random(letters)
    texts = [[rng.randrange(letters) + 2 for _ in range(rng.randrange(0, 60))] for _ in range(50)]
    size = np.array([len(t) + 1 for t in texts])
    base = np.cumsum(size + 1) - (size + 1)
    symbols = np.array([s for t in texts for s in (GUARD, *t, END)], dtype=np.int16)
    out = suffix_arrays(symbols, base, size)
    for text, at, n in zip(texts, base, size):
        ended = [*text, END]
        assert (out[at + 1 : at + 1 + n] - at - 1).tolist() == sorted(range(n), key=lambda i: ended[i:])


def test_a_parse_resumes_within_the_last_factor():
    words = [b"%d" % i for i in range(30)]
    references = [words[:12], words[7:20]]  # the second source takes over within the first factor
    index = {}
    for place, reference in enumerate(references):
        for i in range(len(reference) - 4):
            index.setdefault(tuple(reference[i : i + 5]), (place, i))
    spans = substring_dedup.parse([b"new", *words], index, references, 5)
    covered = {i for a, b in spans for i in range(a, b)}
    assert covered == set(range(1, 21))


def words_of(rows):
    return {r[0]: tuple((r[1] or "").encode().split()) for r in rows}


def bytes_of(rows):
    return {r[0]: (r[1] or "").encode() for r in rows}


def check_words(spark, rows, docs, length):
    found = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs, length).collect()}
    for doc, (n, removed, runs, kept) in without_windows(words_of(rows), length).items():
        own = found[doc]
        assert (own["n_words"], own["n_removed"], own["n_spans"]) == (n, removed, runs)
        assert own["kept_text"].encode() == b" ".join(kept)
    assert len(found) == len(rows)


def check_bytes(spark, rows, docs, length):
    found = {r["doc_id"]: r for r in suffix_dedup.digest(suffix_dedup.without_repeats(docs, length)).collect()}
    for doc, (n, removed, runs, kept) in without_windows(bytes_of(rows), length).items():
        own = found[doc]
        assert (own["n_bytes"], own["n_removed"], own["n_spans"]) == (n, removed, runs)
        assert own["kept_sha256"] == hashlib.sha256(bytes(kept)).hexdigest()


def test_edge_cases_by_words_and_bytes(spark):
    rows = edge_rows()
    check_words(spark, rows, edge_docs(spark), 50)
    check_bytes(spark, rows, edge_docs(spark), 50)


def test_a_passage_with_many_surroundings_and_a_small_window(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(40))
    texts = [" ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    rows = [(i, f"{t} {passage} {u}") for i, (t, u) in enumerate(zip(texts, reversed(texts)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_words(spark, rows, docs, 12)
    check_bytes(spark, rows, docs, 50)


def test_repeats_within_a_document_over_many_slices(spark):
    rng = random.Random(7)
    own = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = own(150).split()
    whole, part = " ".join(passage), " ".join(passage[20:120])
    rows = [(10, f"{own(30)} {whole} {own(40)} {whole} {own(20)} {part}"), (20, f"{part} {own(9)} {part} {whole}"), (3, f"{own(20)} {whole} {own(5)}"), (1, f"{own(4)} {part} {own(70)}")]
    rows += [(30, "x y " * 900), (2, own(60) + " x y" * 40), (31, "-" * 3000), (4, "-" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions(F.desc("doc_id"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")  # every document is a slice of its own
    try:
        check_words(spark, rows, docs, 50)
        check_bytes(spark, rows, docs, 50)
    finally:
        spark.conf.set(setting, before)


def test_no_documents(spark):
    assert substring_dedup.without_repeats(no_docs(spark)).count() == 0
    assert suffix_dedup.without_repeats(no_docs(spark)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, text), (2, text), (1, text), (None, text)], "doc_id long, text string")
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.without_repeats(docs).collect())
    assert removed == [(0, 0), (1, 0), (2, 60), (2, 60)]
