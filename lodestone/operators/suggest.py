"""Dictionaries: exact and prefix look-up, score-ranked suggestion, last-wins and first-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import character_weights


def find(dictionary: DataFrame, key: str) -> DataFrame:
    return dictionary.where(F.col("key") == key)


def prefix_keys(dictionary: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Up to ``limit`` keys below a prefix, in key order."""
    return dictionary.where(F.col("key").startswith(prefix)).orderBy("key").limit(limit)


def prefix_top(dictionary: DataFrame, prefix: str, k: int) -> DataFrame:
    """The ``k`` keys below a prefix with the highest score; the filter is pushed into the scan, the limit into each task."""
    return dictionary.where(F.col("key").startswith(prefix)).orderBy(F.desc("score"), "key").limit(k)


def upsert(entries: DataFrame) -> DataFrame:
    """(key, value) of entries (key, value, ord): the last entry of a key wins."""
    return entries.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def insert_absent(entries: DataFrame) -> DataFrame:
    """The first entry of a key wins."""
    return entries.groupBy("key").agg(F.min_by("value", "ord").alias("value"))


def upsert_scored(entries: DataFrame) -> DataFrame:
    """(key, value, score) of entries (key, value, score, ord): the last entry replaces value and score."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "score"), "ord").alias("e"))
    return last.select("key", "e.value", "e.score")


def character_frequencies(words: DataFrame, column: str) -> DataFrame:
    """Characters by their place-weighted count."""
    each = words.select(F.explode(character_weights(column)).alias("c"))
    return each.groupBy(F.col("c.character").alias("character")).agg(F.sum("c.weight").alias("weight"))
