import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.analysis import LONGEST_TERM, query_terms, tokens


def plain(text):
    up = "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in text or "")
    found = [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", up) if t]
    return [t[i : i + LONGEST_TERM] for t in found for i in range(0, len(t), LONGEST_TERM + 1)]


CASES = [
    None, "", "!!! --- ...", "Under My Skin", 'say "quoted" words', "I've Got You", "Skin deep: naïve skin SKIN", "ß straße ñ Ñ", "a\x7fb", "emoji \U0001f600\U0001f601x",
    "nul\x00inside", "x" * 253, "x" * 254, "x" * 255, "y" * 600, "tab\tnew\nline", "under_score-dash", "3.14 -7", "浜崎あゆみ Ⅲ", "mixed9digits8",
]


def test_terms_of_awkward_texts(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").select("i", tokens("t").alias("x")).collect()
    assert {r.i: list(r.x) for r in got} == {i: plain(t) for i, t in enumerate(CASES)}


def test_long_values_are_capped(spark):
    got = spark.createDataFrame([("a " * 70_000,)], "t string").select(F.size(tokens("t")).alias("n")).first()
    assert got.n == 65_535


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_query_terms_follow_the_same_rules(text):
    assert query_terms(text) == plain(text)


def test_queries_are_bounded():
    assert len(query_terms("a " * 64)) == 64
    with pytest.raises(ValueError):
        query_terms("a " * 65)
