"""From raw documents to token files: five stages, each applying one operator of ``tallygrid.llm`` to what the stage before has kept.

1. ``language``: documents without letters, or whose language is uncertain, go.
2. ``near_duplicates``: of every class of documents linked by a shingle similarity of 0.75 or more, the smallest id stays. Of rows that repeat
   an id and a text one stays; documents without words are no one's duplicates, and neither are rows without an id.
3. ``decontaminated``: documents that overlap with a benchmark item go.
4. ``mixed``: documents are sampled to tempered shares of sources, languages and topics.
5. ``tokens``: the sample is written as range-coded token ids and read back; one row per document.

All stages but the last return the columns of documents, whatever their names. Rows with a null id pass the first two stages as any others. Null and empty texts go in the first stage (they have no letters). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, jaccard_join, langid, mixing, token_output
from tallygrid.llm.common import table
from tallygrid.llm.queries import PIECES, TOKENIZER, public_file
from tallygrid.session import new_work_dir, ship

LEAST_SCORE = 0.5
SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least ``LEAST_SCORE``."""
    model = langid.train(docs, public_file(PIECES))
    found = langid.judged(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN_LANGUAGE) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class."""
    classes = jaccard_join.similar_documents(docs.select("doc_id", "text"))
    smallest = classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(smallest, "doc_id", "left_semi")
    repeated = kept.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter("doc_id is null")).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark overlap."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at tempered shares."""
    return mixing.Mix(docs, share=SHARE).sample(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the sample, read back: start, number and checksum of the ids of each document."""
    return token_output.token_digests(docs, public_file(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES: list[tuple[str, Stage]] = [(stage.__name__, _shipped(stage)) for stage in (language, near_duplicates, decontaminated, mixed, tokens)]

#: Language models, components and range coding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_work_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query = run
