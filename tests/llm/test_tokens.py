import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from edge_cases import edge_docs, edge_rows, no_docs
from tallygrid.llm import rans, token_output
from tallygrid.llm.queries import TOKENIZER, public_file
from tallygrid.llm.token_output import read_tokens, token_digests, write_tokens
from tallygrid.llm.tokens import ByteBpe, byte_bpe
from tallygrid.session import new_work_dir


def whole():
    return Tokenizer.from_file(public_file(TOKENIZER))


def test_parts_encode_as_the_whole():
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "Word", ",", ".", "1", "'s", "\xa0", "é", "#", "<|endoftext|>", "\0", "日本", "\r\n", " "]
    tokenizer, own = whole(), byte_bpe(public_file(TOKENIZER))
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 14)))
        assert np.frombuffer(own.ids(text), own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_strings_of_added_tokens_are_those_tokens():
    own = byte_bpe(public_file(TOKENIZER))
    assert np.frombuffer(own.ids("a <|endoftext|> b"), own.kind).tolist() == [64, 220, 50256, 275]


def test_plain_parts_need_no_whole_tokenizer():
    own, tokenizer = ByteBpe(public_file(TOKENIZER)), whole()
    text = "x9 b1.$$$ (017) 555-7713 end.\nNext12 \u00dcber,\nna\u00efve a_b \"04db\" |"
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    own._whole = None
    assert np.frombuffer(own.ids(text), own.kind).tolist() == expected


def test_ids_are_counted_over_many_documents_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 500, n).astype("<u2") for n in rng.integers(0, 9, 300)]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([d.tobytes() for d in docs], pa.binary())})
    calls, real = [], np.bincount
    monkeypatch.setattr(token_output.np, "bincount", lambda *a, **k: calls.append(1) or real(*a, **k))
    (found,) = token_output._counts("<u2", 500)(iter([batch]))
    total = np.zeros(500, dtype=np.int64)
    total[found.column("token").to_numpy()] = found.column("n").to_numpy()
    assert total.tolist() == real(np.concatenate(docs), minlength=500).tolist() and len(calls) == 1


@pytest.mark.parametrize("lanes", [1, 3, 16, 64])
def test_coding_round_trip_and_checkpoints(lanes):
    rng = np.random.default_rng(lanes)
    ids = (rng.zipf(1.3, 5000) % 700).astype(np.uint32)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=1000)))
    assert int(table.frequency.sum()) == 1 << rans.SCALE
    for n in (0, 1, lanes, lanes + 1, 999, 5000):
        words, at, states = rans.encode(ids[:n], table, lanes, 8)
        assert (rans.decode(words, at, states, n, table, 8) == ids[:n]).all()
        for part in range(len(states)):
            one = rans.decode(words, at, states, n, table, 8, part, 1)
            assert (one == ids[:n][part * 8 * lanes : (part + 1) * 8 * lanes]).all()


def test_frequencies_of_extreme_counts():
    for counts in ([1], [10**12, 1, 1], [1] * 5000 + [10**9], [0, 0, 7]):
        found = rans.frequencies(np.array(counts, dtype=np.int64))
        assert found.sum() == 1 << rans.SCALE and ((found > 0) == (np.array(counts) > 0)).all()
    assert rans.frequencies(np.zeros(5, dtype=np.int64)).sum() == 0


def test_files_hold_all_documents_in_order(spark):
    docs, tokenizer = edge_docs(spark), whole()
    found = {}
    for r in token_digests(docs, public_file(TOKENIZER)).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    start = 0
    for row in sorted(edge_rows(), key=lambda r: r[0]):
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) in found[row[0]]
        start += len(ids)
    assert sum(map(len, found.values())) == len(edge_rows())


def test_null_ids_repeated_rows_and_no_documents(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in token_digests(docs, public_file(TOKENIZER)).collect())
    assert found == [(0, 0, 2), (1, 2, 2), (1, 4, 2)]
    assert token_digests(no_docs(spark), public_file(TOKENIZER)).count() == 0


def test_a_damaged_block_is_noticed(spark):
    from pyspark.sql import functions as F

    path = new_work_dir(spark, "damage")
    files = write_tokens(spark.createDataFrame([(1, "some text to encode")], "doc_id long, text string"), public_file(TOKENIZER), 2, path)
    blocks = spark.read.parquet(files.blocks).withColumn("ids_crc32", F.col("ids_crc32") + 1)
    blocks.write.parquet(f"{path}/bad")
    with pytest.raises(Exception, match="checksum"):
        read_tokens(spark, files._replace(blocks=f"{path}/bad")).collect()
