"""From raw documents to packed sequences: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. Null ids, sources and languages pass through every stage, as do texts of any length; an empty table
gives an empty one. Columns beyond those of documents are kept by all stages but the last; names that begin with __near,
__mix or __quality are the stages' own and an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, quality, secrets, simhash
from lodestone.llm.common import clear_tables, settle_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-chain classifier rejects go; null and blank texts have the labels' prior, repeats one fate."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, model, "__quality").where("__quality >= 0.5").drop("__quality")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more.

    The least id stays, null ids come last; null and wordless texts are one group; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes. Null and empty texts stay as they are; n_chars follows the text."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, laid out by shard; null and wordless texts are never drawn, repeats are rows of their own."""
    return mixing.take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids; a document that is drawn twice is packed twice."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: The stages learn, hash and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each settled in the shared folder before the next reads it; tables that none needs any more go."""
    docs, paths = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        done, paths = paths, []
        docs = settle_table(stage(spark, docs, sf_dir), paths)
        clear_tables(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
