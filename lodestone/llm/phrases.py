"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a text's bytes into short phrases: each symbol takes the index and value of the lowest
bit in which it differs from its left neighbour, again until labels are below six; phrases begin where labels have a
local maximum. A phrase's name is a hash of its symbols, names are the symbols of the next level. Where a cut falls
depends on a few neighbours only, so equal substrings share their interior phrases whatever their offset.

A fingerprint keeps, per level, the least name in each of 64 slots as one byte (0: empty slot); likeness is the share of
used slots that agree. Texts are parsed many at a time in numpy, each as if it stood alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BYTE_NAMES, U, column, keyed_text, mix, powers, shuffle_partitions, slices

#: Levels whose phrase names a fingerprint samples, of about 10 and 35 bytes.
LEVELS = (2, 3)
SLOTS = 64
LONGEST = 256

_POWERS = powers(U(0xA0761D6478BD642F), LONGEST)
_RUN = U(0xE7037ED1A0B428DB)


def _toss_table(symbols: int) -> np.ndarray:
    """label[x * symbols + left]: twice the lowest differing bit's index, plus that bit of x; 0 for equal symbols."""
    x, left = np.divmod(np.arange(symbols * symbols), symbols)
    d = x ^ left
    low = np.where(d, np.bitwise_count((d & -d) - 1), 0)
    return np.where(d, 2 * low + (x >> low & 1), 0).astype(np.uint8)


_TOSS = {n: _toss_table(n) for n in (256, 128, 16, 8)}


def _left(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[0] = 0
    out[1:] = x[:-1]
    out[first] = 0
    return out


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six of symbols of which no two neighbours in a text are equal."""
    left = _left(symbols, first)
    if symbols.dtype == np.uint8:
        out = _TOSS[256][symbols.astype(np.uint16) << 8 | left]
        rounds = (16, 8)
    else:
        d = symbols ^ left
        low = np.bitwise_count((d & (~d + U(1))) - U(1)) & np.uint8(63)
        out = (low << np.uint8(1)) | ((symbols >> low.astype(np.uint64)) & U(1)).astype(np.uint8)
        rounds = (128, 16, 8)
    for n in rounds:
        out = _TOSS[n][out.astype(np.uint16) * np.uint16(n) + _left(out, first)]
    return out


def parse_level(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of concatenated non-empty texts that begin at ``starts``, and where each text's phrases begin."""
    heads = np.empty(len(symbols), bool)
    heads[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=heads[1:])
    heads[starts] = True
    at = np.flatnonzero(heads)
    runs = np.diff(at, append=len(symbols))
    first = np.searchsorted(at, starts)
    symbols = symbols[at]
    labels = _labels(symbols, first)
    cuts = np.empty(len(labels), bool)
    cuts[0] = True
    np.greater(labels[1:], labels[:-1], out=cuts[1:])
    lower = np.empty(len(labels), bool)
    lower[-1] = True
    np.greater_equal(labels[:-1], labels[1:], out=lower[:-1])
    lower[first[1:] - 1] = True  # nothing follows a text's last symbol
    cuts &= lower
    cuts[first] = True
    begin = np.flatnonzero(cuts)
    name = BYTE_NAMES[0][symbols] if symbols.dtype == np.uint8 else symbols
    long = np.flatnonzero(runs > 1)
    if len(long):
        if name is symbols:
            name = name.copy()
        name[long] = mix(name[long] + runs[long].astype(np.uint64) * _RUN)
    place = np.arange(len(name)) - np.repeat(begin, np.diff(begin, append=len(name)))
    names = mix(np.add.reduceat(name * _POWERS[np.minimum(place, LONGEST - 1)], begin) + U(level))
    return names, np.searchsorted(begin, first)


def sketches(texts: list[bytes]) -> np.ndarray:
    """One row of len(LEVELS) * SLOTS bytes for each text."""
    out = np.full((len(texts), len(LEVELS) * SLOTS), 2**64 - 1, np.uint64)
    full = [i for i, t in enumerate(texts) if t]
    if full:
        rows = np.array(full)
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0, *(len(texts[i]) for i in full)])[:-1]
        for level in range(1, max(LEVELS) + 1):
            symbols, starts = parse_level(symbols, starts, level)
            if level in LEVELS:
                of = np.repeat(rows, np.diff(starts, append=len(symbols)))
                slot = of * out.shape[1] + LEVELS.index(level) * SLOTS + (symbols % U(SLOTS)).astype(np.int64)
                np.minimum.at(out.reshape(-1), slot, symbols >> U(6))
    return np.where(out == U(2**64 - 1), U(0), out % U(255) + U(1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of slots used by either in which two sketches agree; 1 where both are empty."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def text_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints in hex."""
    return float(likeness(*(np.frombuffer(bytes.fromhex(x), np.uint8) for x in (a, b))))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        rows = sketches(column(batch, "text").cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([r.tobytes().hex() for r in rows], pa.string())], ["doc_id", "fingerprint"])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each row in, without a shuffle.

    Null and empty texts have the fingerprint of all-empty slots; very long ones are parsed whole, one at a time. Null ids, ties and repeated rows pass through, other
    columns are ignored, an empty table gives no rows.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered within their range, each range closed by the first row of the next one."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    last: tuple | None = None
    for batch in slices(batches, limit=1 << 20):
        rows = list(zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), column(batch, "closes").to_pylist(), strict=True))
        rows = [last, *rows] if last else rows
        last = rows[-1]
        own = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edited = []
        for i in own:
            text, after = rows[i][1], rows[i + 1][1]
            k = len(text) // 2
            edited.append((text[: len(text) - k] + after[:k]).encode())
        prints = sketches([*(t.encode() for _, t, _ in rows), *edited])
        mine, changed, after = prints[own], prints[len(rows) :], prints[[i + 1 for i in own]]
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in own], pa.int64()), pa.array([len(rows[i][1]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()), pa.array([r.tobytes().hex() for r in mine], pa.string()),
            pa.array([r.tobytes().hex() for r in changed], pa.string()), pa.array(likeness(mine, changed)), pa.array(likeness(mine, after)),
        ], names)


def _ranged(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Each row with its range by descending id, and again, for the range before it, where it is the first of its range."""
    names = ["part", "doc_id", "text", "closes"]
    before = lambda ids: (len(cuts) - np.searchsorted(cuts, ids, "left")).astype(np.int32)
    for batch in batches:
        ids = column(batch, "doc_id")
        known, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(top))
        part = np.where(known, before(values), np.int32(len(cuts)))
        yield pa.RecordBatch.from_arrays([pa.array(part), ids, column(batch, "text"), pa.array(np.zeros(len(part), bool))], names)
        least: dict[int, str] = {}
        for i in np.flatnonzero(known & (np.isin(values, cuts) | (values == top))).tolist():
            text = column(batch, "text")[i].as_py()
            least[int(values[i])] = min(text, least.get(int(values[i]), text))
        if least:
            heads = np.array(list(least), np.int64)
            closed = np.where(heads == top, np.int32(len(cuts)), before(heads) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(closed.astype(np.int32)), pa.array(heads), pa.array(list(least.values()), pa.string()), pa.array(np.ones(len(heads), bool))], names)


def edited_neighbours(docs: DataFrame, ranges: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half comes from the next document by descending id.

    Rows are range-partitioned by quantiles of the ids (``ranges`` of them, four for each shuffle partition by default),
    sorted within, and each range also gets the first row of the next one, so texts are shuffled once and no task sees
    more than its ranges. After the last document comes the first. Null ids are last; equal ids are ordered by text, so
    repeated rows follow each other. Null texts are empty, very long ones are parsed whole, one at a time. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    partitions = shuffle_partitions(docs.sparkSession)
    ranges = ranges or 4 * partitions
    marks = rows.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges).alias("at")).first()
    top = 0 if marks.top is None else marks.top
    cuts = np.unique(np.array([x for x in marks["at"] or [] if x < top], np.int64))  # a few for each partition
    placed = rows.mapInArrow(lambda it: _ranged(it, cuts, top), "part int, doc_id long, text string, closes boolean")
    if marks.top is None:  # rows without ids follow each other alone
        first = rows.agg(F.min("text").alias("text")).where("text is not null")
        placed = placed.unionByName(first.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("closes")))
    ordered = placed.repartition(partitions, "part").sortWithinPartitions("part", "closes", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("doc_id", "text", "closes").mapInArrow(_edited, SCHEMA)
