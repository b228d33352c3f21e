"""The queries of this subpackage, each over its whole tables with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contain, licences, lm, minhash, pieces, pii, quality, sharding, tokens, vectors

_found = importlib.util.find_spec("public_tokenizers")
TOKENIZERS = os.path.dirname(_found.origin) if _found and _found.origin else "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spark, _table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled(_table(spark, sf_dir, "documents"), PIECES, digest=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.contained(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(spark, _table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_license_scan, op3_pii, op4_embedding_near_dedup, op5_sentencepiece, op6_decontamination,
        op7_sharding, op8_quality_classifier, op9_token_counts, op10_lm_scoring,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.oracle_sql(),
    "op4_embedding_near_dedup": vectors.oracle_sql(),
    "op6_decontamination": contain.oracle_sql(),
    "op7_sharding": sharding.oracle_sql(),
}
