"""Scores of a term in a document, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking formula.
K1 = 1.4
B = 0.75
PHRASE_FACTOR = 1.4
FIRST_PLACE_BONUS = 25.0


def idf(n_docs: Column, df: Column) -> Column:
    """1 + log2(N / df), so never below one."""
    return 1.0 + F.log2(n_docs / df)


def bm25(tf: Column, dl: Column, avg_dl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """``weight`` is idf times boost."""
    return weight * (k1 + 1) * tf / (tf + k1 * (1 - b) + k1 * b * dl / avg_dl)


def tfidf(tf: Column, weight: Column) -> Column:
    return weight * tf


def rounded(score: Column) -> Column:
    """What results are ordered by: ties in the sixth decimal go to the lower id."""
    return F.round(score, 6)


def shown(score: Column) -> Column:
    """A score as text with four decimals."""
    return F.format_string("%.4f", F.round(score, 4))
