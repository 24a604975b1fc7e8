"""Turning text into terms, as plain column expressions.

Terms are maximal runs of ASCII letters and digits, DEL and everything beyond ASCII; only ASCII letters are folded to
upper case. Runs of more than 253 characters are cut there and lose the next character,
on the document and the query side alike. All terms of a value count, unless a most is asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
LONGEST_TERM = 253
MOST_TERMS = 65_535
MOST_QUERY_TERMS = 64
_CUT = rf"(?s)(.{{1,{LONGEST_TERM}}}).?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """ASCII upper case; other letters stay as they are."""
    return F.translate(_col(c), LOWER, LOWER.upper())


def as_text(c: Column | str, kind: T.DataType) -> Column:
    """A column's indexed form: strings as they are, nested values as JSON, anything else cast; null becomes empty."""
    c = _col(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    elif not isinstance(kind, T.StringType):
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def tokens(c: Column | str, most: int | None = MOST_TERMS) -> Column:
    """The terms of a string in order, at most so many (None: all); no terms for null."""
    plain = F.array_remove(F.split(fold(F.coalesce(_col(c), F.lit(""))), SEPARATORS), "")
    cut = F.flatten(F.transform(plain, lambda t: F.when(F.length(t) > LONGEST_TERM, F.regexp_extract_all(t, F.lit(_CUT), F.lit(1))).otherwise(F.array(t))))
    whole = F.when(F.exists(plain, lambda t: F.length(t) > LONGEST_TERM), cut).otherwise(plain)
    return whole if most is None else F.slice(whole, 1, most)


def query_terms(text: str) -> list[str]:
    """The terms of a query, on the driver; repeats stay, since they weigh more."""
    found = [t for t in re.split(SEPARATORS, re.sub("[a-z]", lambda m: m[0].upper(), text or "")) if t]
    out = [t[i : i + LONGEST_TERM] for t in found for i in range(0, len(t), LONGEST_TERM + 1)]
    if len(out) > MOST_QUERY_TERMS:
        raise ValueError(f"a query holds at most {MOST_QUERY_TERMS} terms")
    return out


def character_weights(word: Column | str) -> Column:
    """(character, weight) of each place of a word; earlier places weigh more."""
    w = _col(word)
    return F.transform(F.filter(F.split(w, ""), lambda ch: ch != ""), lambda ch, i: F.struct(ch.alias("character"), (F.length(w) - i).cast("long").alias("weight")))
