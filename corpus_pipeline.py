"""A corpus pipeline over ``documents``: quality, near-duplicates, benchmark leaks, personal data, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import contain, minhash, pieces, pii, quality
from constella.llm.queries import PIECES
from constella.llm.store import Scratch, beside


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(beside(ids), "doc_id", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on ``labels``, rejects."""
    return quality.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by similarity 0.8 or more on five-word shingles.

    Rows without an id stay. Of rows that repeat an id the least one stays, by text and then by the other columns.
    """
    scratch = Scratch(spark)
    found = scratch.save(minhash.near_duplicates(spark, docs, k=5).where("doc_id is not null"))
    repeated = scratch.save(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = _without(docs, scratch.save(found.where("not kept").select("doc_id").distinct()))
    if repeated.isEmpty():
        return kept
    order = ["text", *[c for c in docs.columns if c != "text"]]
    least = kept.join(beside(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("r"))
    return _without(kept, repeated).unionByName(least.select("r.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    found = contain.contained(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, Scratch(spark).save(found.select("doc_id").distinct()))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind."""
    masked = pii.masked(pii.find(spark, docs))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast("long"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_pieces, pieces``."""
    return pieces.sampled(docs, PIECES, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_masking),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: No stage but decontamination can be said in SQL; the tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
