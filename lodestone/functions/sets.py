"""Sorted arrays, distinct members, substring and bit tests, as expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_arrays(df: DataFrame, key: str, *values: str, descending: bool = False) -> DataFrame:
    """(key, values...): each key's rows as parallel arrays, ordered by the first value and then the others."""
    rows = F.sort_array(F.collect_list(F.struct(*values)), asc=not descending)
    return df.groupBy(key).agg(rows.alias("rows")).select(key, *(F.col(f"rows.{v}").alias(v) for v in values))


def distinct_members(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): how many different values a key has; values are made distinct before any shuffle counts them."""
    return df.select(key, value).dropDuplicates().groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def first_occurrences(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): each value with the least place at which it occurs."""
    return df.groupBy(value).agg(F.min(order).alias("first"))


def contains(c: Column, part: str) -> Column:
    return c.contains(part)


def bit_is_set(c: Column, bit: int) -> Column:
    return F.getbit(c, F.lit(bit)) == 1


def with_bit(c: Column, bit: int) -> Column:
    return c.bitwiseOR(F.lit(1 << bit))


def without_bit(c: Column, bit: int) -> Column:
    return c.bitwiseAND(F.lit(~(1 << bit)))
