"""Result texts: HTML escaping, highlighting, JSON rows, query strings."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = '<span class="highlight">', "</span>"
MOST_HIGHLIGHTS = 6


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _plain(words: str) -> list[str]:
    return [w for w in (re.sub("[^a-z0-9]", "", t.lower()) for t in words.split()[:MOST_HIGHLIGHTS]) if w]


def mark(text: str | None, words: list[str]) -> str | None:
    """Exact highlighting: matches over letters and digits alone, overlapping and touching ranges merged, the rest escaped."""
    if text is None:
        return None
    kept = [(ch, i) for i, c in enumerate(text) if re.fullmatch("[a-z0-9]", ch := c.lower())]
    flat = "".join(ch for ch, _ in kept)
    ranges = []
    for w in words:
        at = flat.find(w)
        while at >= 0:
            ranges.append((kept[at][1], kept[at + len(w) - 1][1] + 1))
            at = flat.find(w, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, done = [], 0
    for a, b in merged:
        out += [html.escape(text[done:a]), OPEN, html.escape(text[a:b]), CLOSE]
        done = b
    return "".join([*out, html.escape(text[done:])])


def highlight(c: Column, query: str) -> Column:
    """Exact highlighting with merged ranges, an Arrow UDF over the few rows of a result; without words the text is only escaped."""
    words = _plain(query)
    if not words:
        return escape_html(c)
    return F.pandas_udf(lambda s: pd.Series([mark(t, words) for t in s], dtype=object), "string")(c)


def decode_query(c: Column) -> Column:
    """A query string ``a=b&c=d`` as a map with upper-cased names; + is a space, %XX a byte."""
    pairs = F.filter(F.split(c, "&"), lambda p: p.contains("="))
    name = lambda p: F.translate(F.substring_index(p, "=", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    value = lambda p: F.url_decode(F.regexp_replace(p, "^[^=]*=", ""))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(name(p), value(p))))
