"""Queries that apply the operators to the driver tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, flat_graph, jaccard_join, langid, merkle, mixing, periodic_runs, substring_dedup, suffix_dedup, surrogates, token_output, topk, warc
from .common import table

#: Where the public tokenizer files lie; the installed package tells.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ship(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that a smaller document holds."""
    return substring_dedup.digest(substring_dedup.without_repeats(table(spark, sf_dir, "documents")))


@_query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller document holds."""
    return suffix_dedup.digest(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


def public_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as range-coded token ids and read back."""
    return token_output.token_digests(table(spark, sf_dir, "documents"), public_file(TOKENIZER))


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, public_file(PIECES)))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that are linked by similar sets of word shingles."""
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(found)


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of sources, languages and topics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    sample = mixing.Mix(docs).sample(docs)
    return sample.select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), F.round("weight", 9).alias("weight"))


@_query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of highest inner product for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    return warc.page_digests(table(spark, sf_dir, "pages"))


ORACLES["op7_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
    SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest
"""


@_query
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """The documents of the periodic-run query: every tenth one, by the checksum of its id, repeats a stretch of itself up to its end."""
    # Each step is a column of its own: inside the lambda, an expression would be worked out again for every word.
    own = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("checksum"))
    chosen = F.when(F.col("checksum") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = own.select("doc_id", "text", F.floor(F.col("checksum") / 10).alias("mixed"), chosen.alias("words")).withColumn("size", F.nullif(F.size("words"), F.lit(0)))
    placed = split.withColumn("start", (F.col("mixed") % F.col("size")).cast("int")).withColumn(
        "period", (1 + F.floor((F.col("size") - F.col("start")) / (3 + F.col("mixed") % 8))).cast("int")
    )
    repeated = F.transform("words", lambda word, i: F.when(i < F.col("start"), word).otherwise(F.get("words", F.col("start") + (i - F.col("start")) % F.col("period"))))
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the one of most periods, and the text without repetitions."""
    found = periodic_runs.without_repetitions(planted_periods(table(spark, sf_dir, "documents")))

    def most_periods(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.get(F.array_sort("runs", most_periods), F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op12_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of vectors with a cosine of 0.9 or more."""
    return flat_graph.linked_vectors(table(spark, sf_dir, "embeddings"), 0.9)


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in trees per language, and what becomes of them when some character counts are changed."""
    docs = table(spark, sf_dir, "documents")

    def leaf(n_chars):
        return merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang")], n_chars, F.col("text"))

    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), leaf(F.col("n_chars")).alias("digest"), changed.alias("claim"), F.col("doc_id").alias("payload"))
    checks = merkle.Manifest(leaves).checks()
    return checks.withColumnRenamed("payload", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
