"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is its own shape and the shapes of the lines before and after it, and a chain of
two states joins neighbours. Forward-backward marginals, weighted by the lines' lengths, give the document's share of
good text, which a logistic curve turns into the probability of label 1.

Labels are of documents, states of lines. The chain is fitted as if every line had its document's label, so it sees few
moves between states. Refinements, none by default, then put its own marginals, pulled towards that label, in the labels'
place, so that good lines in bad documents are learnt as such; where documents are of one kind throughout, that costs accuracy.

The chain is fitted on at most ``max_labelled`` labelled documents (the bound is a parameter; they are chosen by a hash of
the id) whose line shapes, not texts, come to the driver. Scoring is one pass over whole texts without a shuffle: many
documents advance together, line by line, in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import RollingHash, bound_batches, column, keyed_text, slices, utf8

#: Byte classes whose shares describe a line.
_BYTES = np.arange(256)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_STOPS = np.isin(_BYTES, list(b".,;:'\"?-()"))
_BAR = np.isin(_BYTES, list(b"|<>{}[]\\/=_~"))
_MARK = np.isin(_BYTES, list(b"#$%&*@^+"))
_BANG = _BYTES == 33
_CLASSES = (_LOWER, _UPPER, _DIGIT, _SPACE, _STOPS, _BAR, _MARK, _BANG)
#: One number for each byte class, with which all classes are counted at once: eight counters of eight bits, for blocks of at most 255 bytes.
_PACKED = sum(c.astype(np.uint64) << np.uint64(8 * k) for k, c in enumerate(_CLASSES))
FEATURES = len(_CLASSES) + 10


@dataclass
class Lines:
    """Lines of many documents: features, lengths in bytes, and each document's first line (one more than documents)."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray


def line_shapes(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    """Shapes of the non-blank lines of concatenated texts; ``offsets`` as in Arrow."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(raw)]
    if not len(starts):
        return Lines(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64))
    ends = np.append(starts[1:], len(raw))
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(raw), 128)]))  # no block is longer than 128 bytes
    packed = np.add.reduceat(_PACKED[raw], cuts)
    of = np.searchsorted(cuts, starts)
    counts = np.stack([np.add.reduceat((packed >> np.uint64(8 * k)) & np.uint64(255), of) for k in range(len(_CLASSES))], axis=1).astype(np.float32)
    length = ends - starts
    words = np.maximum(1, counts[:, 3])
    share = counts / length[:, None]
    hashes = RollingHash(raw)
    names = hashes.ranges(starts, ends)
    inside = ~_SPACE[raw]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[starts], after[ends - 1] = False, False  # texts follow each other without a space
    begun = np.flatnonzero(inside & ~before)
    word = hashes.ranges(begun, np.flatnonzero(inside & ~after) + 1)
    line = np.searchsorted(starts, begun, side="right") - 1
    stutter = np.bincount(line[1:][(word[1:] == word[:-1]) & (line[1:] == line[:-1])], minlength=len(starts)) / words
    doc = np.searchsorted(offsets, starts, side="right") - 1
    again = np.zeros(len(starts), np.float32)
    order = np.lexsort((names, doc))
    same = (names[order][1:] == names[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:][same]] = 1
    last = raw[np.maximum(starts, ends - 2)]
    some = (share[:, 5:8] > 0.02).astype(np.float32)
    features = np.column_stack([share, some, stutter, np.log1p(length) / 5, length / words / 10, np.minimum(words, 50) / 50, again, _UPPER[raw[starts]], np.isin(last, list(b".!?:"))]).astype(np.float32)
    kept = np.flatnonzero(counts[:, 3] < length)
    return Lines(features[kept], length[kept], np.searchsorted(doc[kept], np.arange(n_docs + 1)))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own, previous and next line's features, flags for a missing neighbour, and a constant."""
    f, n = lines.features, len(lines.features)
    out = np.zeros((n, 3 * FEATURES + 3), np.float32)
    if not n:
        return out
    heads = np.zeros(n, bool)
    heads[lines.first[:-1][np.diff(lines.first) > 0]] = True
    tails = np.append(heads[1:], True)
    out[:, :FEATURES] = f
    out[1:, FEATURES : 2 * FEATURES] = f[:-1]
    out[heads, FEATURES : 2 * FEATURES] = 0
    out[:-1, 2 * FEATURES : 3 * FEATURES] = f[1:]
    out[tails, 2 * FEATURES : 3 * FEATURES] = 0
    out[:, -3], out[:, -2], out[:, -1] = heads, tails, 1
    return out


def marginals(emission: np.ndarray, switch: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, the expected transitions (2 x 2) and the log partition of all chains.

    ``emission`` is each line's log-odds of good, ``switch`` the transitions' log-potentials. All chains advance together.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")  # chains longer than t
    local = np.stack([np.ones(len(emission)), np.exp(np.clip(emission, -30, 30))], axis=1)
    t, ahead, total = np.exp(switch), np.ones((len(emission), 2)), 0.0
    back = np.ones((len(emission), 2))
    for step, n in enumerate(live.tolist()):
        at = begin[:n] + step
        a = local[at] * (ahead[at - 1] @ t if step else 1.0)
        scale = a.sum(axis=1, keepdims=True)
        ahead[at] = a / scale
        total += float(np.log(scale).sum())
    moves = np.zeros((2, 2))
    for step in range(len(live) - 2, -1, -1):
        at = begin[: live[step + 1]] + step
        next_ = local[at + 1] * back[at + 1]
        pair = ahead[at][:, :, None] * t[None] * next_[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = next_ @ t.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(axis=1), moves, total


@dataclass
class Model:
    """Weights of the chain and of the logistic curve over a document's share of good text; ``prior`` is for documents without lines."""

    weights: np.ndarray
    switch: np.ndarray
    slope: float
    bias: float
    prior: float

    def scores(self, lines: Lines) -> np.ndarray:
        n = len(lines.first) - 1
        out = np.full(n, self.prior)
        full = np.flatnonzero(np.diff(lines.first) > 0)
        if len(full):
            good, _, _ = marginals(with_neighbours(lines) @ self.weights, self.switch, lines.first)
            begin = lines.first[:-1][full]
            share = np.add.reduceat(good * lines.length, begin) / np.add.reduceat(lines.length.astype(float), begin)
            out[full] = 1 / (1 + np.exp(-(self.slope * share + self.bias)))
        return out


#: How strongly a document's label pulls its lines, in log-odds of good.
PULL = 2.0


def fit(lines: Lines, labels: np.ndarray, rounds: int = 200, l2: float = 1e-3, refinements: int = 0) -> Model:
    """Maximum conditional likelihood of the lines' states, by Adam; then the curve by Newton steps.

    States are the documents' labels at first; each refinement replaces them by their posteriors under the model and the
    labels' pull (expectation-maximisation), for a quarter of the rounds.
    """
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    x, y = with_neighbours(lines), np.repeat(labels, np.diff(lines.first)).astype(float)
    dim = x.shape[1]
    theta = np.zeros(dim + 4)
    if not len(y) or labels.min() == labels.max():
        return Model(theta[:dim], theta[dim:].reshape(2, 2), 0.0, math.log(prior / (1 - prior)), prior)
    inner = np.ones(len(y), bool)
    inner[lines.first[:-1][np.diff(lines.first) > 0]] = False
    states, seen = y, np.zeros((2, 2))
    np.add.at(seen, (y.astype(int)[np.flatnonzero(inner) - 1], y.astype(int)[inner]), 1)
    for stage in range(1 + refinements):
        if stage:
            states, seen, _ = marginals(x @ theta[:dim] + PULL * (2 * y - 1), theta[dim:].reshape(2, 2), lines.first)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, (rounds // 4 if stage else rounds) + 1):
            p, moves, _ = marginals(x @ theta[:dim], theta[dim:].reshape(2, 2), lines.first)
            grad = np.concatenate([x.T @ (p - states), (moves - seen).ravel()]) / len(y) + l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(theta[:dim].copy(), theta[dim:].reshape(2, 2).copy(), 1.0, 0.0, prior)
    good, _, _ = marginals(x @ model.weights, model.switch, lines.first)
    full = np.flatnonzero(np.diff(lines.first) > 0)
    begin = lines.first[:-1][full]
    share = np.add.reduceat(good * lines.length, begin) / np.add.reduceat(lines.length.astype(float), begin)
    a, target, w = np.column_stack([share, np.ones(len(share))]), labels[full].astype(float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, a.T @ (target - p) - 1e-2 * w)
    model.slope, model.bias = float(w[0]), float(w[1])
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3. Null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lines = line_shapes(*utf8(column(batch, "text")))
        parts = [(lines.features[a:b].tobytes(), lines.length[a:b].tobytes()) for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality"), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["doc_id", "quality", "features", "lengths"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 5000, max_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_labelled`` labelled documents of at most ``max_bytes`` bytes each, none of them held out.

    Null qualities and unknown ids are left out; a document that is labelled twice has its lower label. Without two
    different labels the model is the labels' prior (one half without any).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = keyed_text(docs, id_col, text_col).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    rows = texts.select("doc_id", "quality", "text").mapInArrow(_shapes, "doc_id long, quality int, features binary, lengths binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    lengths = [np.frombuffer(r.lengths, np.int64) for r in rows]
    features = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows]
    lines = Lines(np.concatenate([np.zeros((0, FEATURES), np.float32), *features]), np.concatenate([np.zeros(0, np.int64), *lengths]), np.cumsum([0, *map(len, lengths)]))
    return fit(lines, np.array([r.quality for r in rows], np.int64))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text = column(batch, "text").fill_null("")
        scores = model.scores(line_shapes(*utf8(text)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])


def with_quality(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """The whole table (which has a column ``text``) with one more column, the score; null and blank texts have the prior.

    The new column's name must be free; rows, nulls, ties and repeats stay as they are.
    """
    if name in docs.columns:
        raise ValueError(f"{name} is taken")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return bound_batches(docs).mapInArrow(lambda it: _scored(it, model, name), schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and blank texts have the labels' prior, null ids keep their rows; very long texts are scored whole, one at a time.
    Repeated rows and ties are scored alike, one row out for each row in. Other columns are ignored; an empty table gives
    no rows.
    """
    model = train(docs, labels, max_labelled, id_col=id_col, text_col=text_col)
    scored = with_quality(keyed_text(docs, id_col, text_col), model, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
