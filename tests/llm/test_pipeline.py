import glob
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from edge_cases import classes, edge_docs, no_docs
from test_jaccard_join import alike, shingle_set
from tallygrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_warc_query_equals_its_sql(spark):
    import check
    import duckdb

    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert check.compare(spark, found, "op7_warc", SF)[0].startswith("ok")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        found[name] = docs = spark.read.parquet(str(tmp_path / name))
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminated", "mixed", "tokens"]
    assert all(found[name].columns == ["doc_id", "text", "lang", "source", "n_chars"] for name, _ in cp.STAGES[:-1])
    texts = {r["doc_id"]: shingle_set(r["text"]) for r in found["language"].collect()}
    assert len(texts) > 190
    least = classes(texts, alike)
    assert sorted(r["doc_id"] for r in found["near_duplicates"].collect()) == sorted(d for d in texts if least[d] == d)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in found["decontaminated"].collect()}
    for r in found["near_duplicates"].collect():
        leaked = any(item in " ".join(r["text"].lower().split()) for item in items)
        assert (r["doc_id"] in kept) != leaked
    assert found["tokens"].count() == found["mixed"].count() > 0.5 * len(kept)


def test_stages_bear_edge_cases(spark, tmp_path):
    for number, docs in enumerate((edge_docs(spark), no_docs(spark))):
        for name, stage in cp.STAGES:
            path = str(tmp_path / f"{number}-{name}")
            columns = docs.columns
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "tokens" or docs.columns == columns


def test_a_column_of_a_found_name_and_rows_without_id(spark):
    docs = spark.createDataFrame(
        [(None, "a line of its own with quite some words", "x"), (1, "one two three four five six seven", "y"), (1, "one two three four five six seven", "y"),
         (2, "one two three four five six seven", "z")], "doc_id long, text string, language_found string"
    )
    kept = cp.near_duplicates(spark, docs, SF)
    assert sorted([tuple(r) for r in kept.collect()], key=str) == sorted([tuple(r) for r in docs.take(2)], key=str)
    labelled = spark.read.parquet(f"{SF}/documents.parquet").withColumn("language_found", __import__("pyspark").sql.functions.lit("kept"))
    found = cp.language(spark, labelled, SF)
    assert found.columns == labelled.columns and found.first()["language_found"] == "kept"
