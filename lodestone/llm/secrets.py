"""Secret scans: three base patterns, and windows of high Shannon entropy per character class inside long strings.

The scan is one ``mapInArrow`` pass over whole texts with no shuffle. Entropy over a sliding window is kept by
incremental counts: one character enters, one leaves, and only the two changed terms of sum(c * log2 c) are renewed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import bound_batches, column, keyed_text, slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
#: Strings in which entropy is looked for, and the classes in order: each with its characters, window and least bits per character.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.9),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"), 20, 4.0),
)
#: Maximal runs of each class that fill its window; the lookbehind keeps a failed run from being tried from each of its characters.
RUNS = tuple(re.compile(rf"(?<![{c}])[{c}]{{{w},}}") for c, w in (("".join(re.escape(x) for x in sorted(chars)), window) for _, chars, window, _ in CLASSES))
#: A candidate that matches one of these is no secret: words and numbers joined by dashes, one letter case only, digits only, placeholders.
ALLOW = tuple(re.compile(p) for p in (r"[A-Za-z]?[a-z]++(?:[_/=-]++(?:[A-Z]?[a-z]++|[A-Z])?+)*+", r"[A-Z]++(?:[_/=-]++[A-Z]*+)*+", r"[0-9_/=+-]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i).*(example|placeholder|x{6,}|lorem).*"))


def high_windows(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal ranges covered by windows of that many characters whose Shannon entropy is at least ``least`` bits."""
    if len(text) < window:
        return
    term = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]  # one more enters before one leaves
    counts: dict[str, int] = {}
    total, begun, end = 0.0, -1, -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            if begun >= 0 and i - window + 1 > end:
                yield begun, end
                begun = -1
            if begun < 0:
                begun = i - window + 1
            end = i + 1
    if begun >= 0:
        yield begun, end


def entropy_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the high-entropy parts of candidate strings.

    Each maximal run of a class's characters is tested by that class's window and threshold, unless the allow-list takes
    it. Spans that meet are merged and count for the narrowest class among them.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if any(a.fullmatch(word) for a in allow):
            continue
        spans = []
        for rank, ((_, _, window, least), run) in enumerate(zip(CLASSES, RUNS, strict=True)):
            for r in run.finditer(word):
                if r[0] == word or not any(a.fullmatch(r[0]) for a in allow):
                    spans += [(r.start() + a, r.start() + b, rank) for a, b in high_windows(r[0], window, least)]
        merged: list[list[int]] = []
        for a, b, rank in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), min(rank, merged[-1][2])]
            else:
                merged.append([a, b, rank])
        found += [(m.start() + a, m.start() + b, f"entropy_{CLASSES[rank][0]}") for a, b, rank in merged]
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The three base kinds, leftmost and without overlaps within a kind, ordered by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def secret_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: base and entropy."""
    base = base_spans(text)
    return base, sorted([*base, *entropy_spans(text)], key=lambda s: (s[0], (*BASE_KINDS, s[2]).index(s[2]), s[2]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text in column(batch, "text").to_pylist():
            base, spans = secret_spans(text)
            kinds = [k for _, _, k in base]
            out.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts and spans (code points, end exclusive).

    Null and empty texts have no spans; very long ones are scanned whole, in time that grows with their length. Null ids,
    ties and repeated rows pass through one for one; other columns are ignored; an empty table gives an empty result.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(_rows, SCHEMA)


def _masked(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        at, out = batch.schema.get_field_index("text"), []
        for text in batch.column(at).to_pylist():
            parts, done = [], 0
            for a, b, _ in secret_spans(text)[1] if text is not None else []:
                if b > done:
                    parts += [text[done : max(a, done)], mask if a >= done else ""]
                    done = b
            out.append("".join([*parts, text[done:]]) if parts else text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def mask_secrets(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """The same table with every secret in column ``text`` replaced by ``mask`` (overlapping spans by one).

    Null texts stay null, empty ones empty; very long ones are masked whole. Rows, ties, repeats and all other columns stay
    as they are, whatever their names; an empty table stays empty.
    """
    return bound_batches(docs).mapInArrow(lambda it: _masked(it, mask), docs.schema)
