"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import media, mixing, packing, phrases, pii, quality, secrets, simhash, suffixes, treeweights


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edited_neighbours(_documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))[0].drop("source")


def op9_tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treeweights.score_documents(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_phrase_fingerprints, op2_media_columns, op3_packing, op4_suffix_dedup, op5_pii, op6_secret_scans, op7_simhash, op8_mixing, op9_tree_weights, op10_quality)}


def oracle_sql() -> dict[str, str]:
    """SQL can't name tokenizers, fitted models and 64-bit hashes; tests hold the other queries against brute force instead."""
    return {"op4_suffix_dedup": suffixes.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
