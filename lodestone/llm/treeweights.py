"""Language-model scores by context-tree weighting.

A text is its lower-cased words joined by single spaces, closed by a line feed, as bytes. Each byte is eight binary
decisions; each decision node has a tree of contexts, the last 0 to DEPTH bytes, with a Krichevsky-Trofimov estimator at
every context. A context's weighted probability is half its own estimate and half the product of its children's, so
after counting, every byte's probability mixes the estimates of all depths by their posterior weights. DEPTH is 5: a byte
and its context fit one 64-bit key; each depth more would about double what is counted and sent.

Estimates depend on final counts only, so learning is counting: blocks of texts name their distinct byte strings of
length DEPTH + 1 and their words, by buckets (the two bytes before the predicted one; the first bits of a word's name).
Counts go up a tree: the tables of up to MERGED_NODES nodes are added up into one, until one node is left; words get finer
buckets at a level where theirs would become large. Answers go down the same tree, each node giving its children what they named. So no group grows
with the corpus, and no answer is sent where nobody asked. At the top a bucket of more than PIECE_KEYS strings is cut by the
third byte; pieces are weighed down to depth three each by itself, and combined upwards to their bucket and to the 256
contexts of depth one, which alone (fixed-size arrays) come to the driver with a few totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import RollingHash, U, column, keyed_text, settle_table, shuffle_partitions, slices

DEPTH = 5
HELD_OUT = 10
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
SLICE_ROWS = (1 << 16) - 1
#: Nodes whose tables are added up in one go, and strings of a bucket that are weighed together.
MERGED_NODES, PIECE_KEYS = 32, 1 << 18
#: Bits of a word's name that choose its bucket at the leaves, how many more a finer level has, and bytes of one bucket in MERGED_NODES nodes that call for it.
WORD_BITS, FINER_BITS, BUCKET_BYTES = 9, 5, 8 << 20
GRAMS, WORDS, DIGEST = 0, 1, 2
_END = b"\n"


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text leaves 0 when divided by 10; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, then zstd."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def deltas(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (of ones without counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.diff(head, append=len(keys)) if counts is None else np.add.reduceat(counts, head)


class Slice:
    """Byte strings and words of some texts, with the text's number in each."""

    def __init__(self, texts: list[str]) -> None:
        lines = [b" ".join(t.encode().lower().split()) for t in texts]
        raw = np.frombuffer(b"".join([_END * DEPTH + x + _END for x in lines]), np.uint8)
        size = np.array([len(x) + 1 for x in lines], np.int64)
        self.size = size
        starts = np.cumsum(size + DEPTH) - size
        self.doc = np.repeat(np.arange(len(lines), dtype=np.int32), size)
        at = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
        wide = raw.astype(np.uint64)
        keys = np.zeros(len(raw), np.uint64)
        for k in range(1, DEPTH + 1):  # the last byte before the predicted one is the highest
            keys[DEPTH:] |= wide[DEPTH - k : len(raw) - k] << U(8 * (DEPTH + 1 - k))
        keys |= wide
        self.keys = keys[at]
        inside = (raw != 32) & (raw != 10)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin = np.flatnonzero(edge == 1)
        self.words = RollingHash(raw).ranges(begin, np.flatnonzero(edge == -1))
        self.word_doc = np.searchsorted(starts, begin, side="right") - 1


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(block, slice, whether the block ends): the same for every pass over the same table."""
    context = TaskContext.get()
    block, size, before = (context.partitionId() if context else 0) << 24, 0, None
    for batch in slices(batches, limit=SLICE_BYTES):
        if before is not None:
            yield block, before, size >= block_bytes
            if size >= block_bytes:
                block, size = block + 1, 0
        size += int(column(batch, "text").nbytes)
        before = batch
    if before is not None:
        yield block, before, True


NODES = "space int, bucket long, node long, keys binary, counts binary"


def block_digest(keys: np.ndarray, words: np.ndarray) -> int:
    """What a block asks for: its distinct byte strings and words, in order."""
    return xxhash.xxh3_64_intdigest(keys.tobytes() + words.tobytes()) - (1 << 63)


def _node_rows(space: int, node: int, word_bits: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """A node's table of distinct keys in order, by buckets."""
    bucket = (keys >> U(8 * (DEPTH - 1) if space == GRAMS else 64 - word_bits)).astype(np.int64)
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(keys)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield space, int(bucket[a]), node, deltas(keys[a:b]), squeeze(counts[a:b].astype(np.uint64))


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], [c for c, _ in fields])


def _requests(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {GRAMS: [], WORDS: []}
    for block, batch, ends in blocks(batches, block_bytes):
        part = Slice(column(batch, "text").to_pylist())
        train = ~np.array([held_out(d) for d in column(batch, "doc_id").to_pylist()])
        for space, keys, doc in ((GRAMS, part.keys, part.doc), (WORDS, part.words, part.word_doc)):
            learnt = train[doc]
            a, n = summed(keys[learnt])
            b, _ = summed(keys[~learnt])
            held[space].append((np.concatenate([a, b]), np.concatenate([n, np.zeros(len(b), np.int64)])))
        if ends:
            tables = {space: summed(*(np.concatenate(c) for c in zip(*parts, strict=True))) for space, parts in held.items()}
            rows = [r for space, table in tables.items() for r in _node_rows(space, block, WORD_BITS, *table)]
            yield _columns([*rows, (DIGEST, block_digest(tables[GRAMS][0], tables[WORDS][0]), block, None, None)], NODES)
            held = {GRAMS: [], WORDS: []}


def _merged(table: pa.Table, word_bits: int) -> pa.Table:
    """The sums of some nodes' tables of one bucket, as a table of their parent; one after the other is added."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
        waiting.append((undeltas(k.as_py()), unsqueeze(c.as_py(), np.uint64).astype(np.int64)))
        if sum(len(w[0]) for w in waiting) > max(len(keys), 1 << 16):
            keys, counts = summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True)))
            waiting = []
    keys, counts = summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True)))
    return pa.Table.from_batches([_columns(list(_node_rows(table.column("space")[0].as_py(), table.column("up")[0].as_py(), word_bits, keys, counts)), NODES)])


PIECES = "bucket int, piece int, keys binary, counts binary"


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each merged bucket as one piece, or if it is large, one for each byte that comes third before the predicted one."""
    for batch in batches:
        for bucket, keys, counts in zip(*(column(batch, c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
            k, n = undeltas(keys), unsqueeze(counts, np.uint64)
            third = ((k >> U(8 * (DEPTH - 2))) & U(255)).astype(np.int32) if len(k) > most else np.zeros(len(k), np.int32)
            cuts = [*np.flatnonzero(np.diff(third, prepend=-1)).tolist(), len(k)]
            ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
            blobs = [pa.array([f(x[a:b]) for a, b in ranges], pa.binary()) for f, x in ((deltas, k), (squeeze, n))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), bucket, np.int32)), pa.array(third[cuts[:-1]]), *blobs], [x.split()[0] for x in PIECES.split(", ")])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series after eight steps up."""
    y = x + 8
    low = np.log(x)
    for k in range(1, 8):
        low = low + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The contexts of one depth below a bucket: for each of the eight bits, the decision nodes with counts and weights."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray) -> None:
        self.strings, nxt = strings, (strings & U(255))
        base = (strings >> U(8)) << U(8)
        self.nodes, self.index, self.zeros, self.ones, self.own = [], [], [], [], []
        for bit in range(8):
            node = base | U(1 << bit) | (nxt >> U(8 - bit))
            head = np.append(True, node[1:] != node[:-1])
            at = np.flatnonzero(head)
            one = ((nxt >> U(7 - bit)) & U(1)).astype(np.float64)
            ones = np.add.reduceat(counts * one, at)
            zeros = np.add.reduceat(counts * (1 - one), at)
            self.nodes.append(node[at])
            self.index.append(np.cumsum(head) - 1)
            self.zeros.append(zeros)
            self.ones.append(ones)
            self.own.append(log_kt(zeros, ones))
        self.weighted = list(self.own)
        self.stop = [np.ones(len(x)) for x in self.own]

    def weigh(self, deeper: Level) -> None:
        """Half the own estimate, half the product of the children's."""
        for bit in range(8):
            below = np.bincount(np.searchsorted(self.nodes[bit], deeper.parents(bit)), weights=deeper.weighted[bit], minlength=len(self.nodes[bit]))
            self.weighted[bit] = np.logaddexp(self.own[bit], below) - np.log(2)
            self.stop[bit] = np.exp(self.own[bit] - np.log(2) - self.weighted[bit])

    def parents(self, bit: int) -> np.ndarray:
        return (self.nodes[bit] >> U(16) << U(8)) | (self.nodes[bit] & U(255))


def subtree(strings: np.ndarray, counts: np.ndarray, depths: int) -> list[Level]:
    """Levels from one to ``depths`` bytes of context below a bucket; strings are context bytes (nearest first) and the predicted byte."""
    levels = []
    for d in range(1, depths + 1):
        if d == depths:
            k, n = strings, counts
        else:
            k, n = summed(((strings >> U(8 * (depths + 1 - d))) << U(8)) | (strings & U(255)), counts)
        levels.append(Level(k, n.astype(np.float64)))
    for d in range(depths - 2, -1, -1):
        levels[d].weigh(levels[d + 1])
    return levels


def _piece_strings(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return undeltas(keys) & U((1 << 8 * (DEPTH - 1)) - 1), unsqueeze(counts, np.uint64).astype(np.int64)


SUMS = "bucket int, piece int, counts binary, below binary"


def piece_sums(strings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a piece adds to its bucket: counts by predicted byte, and ln of the weighted probability by node."""
    top = subtree(strings, counts, DEPTH - 2)[0]
    below = sum(np.bincount((top.nodes[bit] & U(255)).astype(np.int64), weights=top.weighted[bit], minlength=256) for bit in range(8))
    return np.bincount((strings & U(255)).astype(np.int64), weights=counts, minlength=256), below


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[x.tobytes() for x in piece_sums(*_piece_strings(*row))] for row in zip(*(column(batch, c).to_pylist() for c in ("keys", "counts")), strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "bucket"), column(batch, "piece"), *(pa.array([r[i] for r in out], pa.binary()) for i in (0, 1))], [x.split()[0] for x in SUMS.split(", ")])


def weigh_nodes(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (rows) with counts by predicted byte and ln of their children's product by node (heap order): the estimates of a one, the weights of stopping there, ln of the weighted probability."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for node in range(255, 0, -1):
        total[:, node] = total[:, 2 * node] + total[:, 2 * node + 1]
    zeros, ones = total[:, 0::2][:, :256].copy(), total[:, 1::2][:, :256].copy()
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) - np.log(2)
    weighted[:, 0] = 0
    return (ones + 0.5) / (zeros + ones + 1), np.exp(own - np.log(2) - weighted), weighted


CONTEXTS = "bucket int, near int, ones binary, stop binary, counts binary, weighted binary"


def _bucket_context(table: pa.Table) -> pa.Table:
    """The context of a bucket's two bytes, from its at most 256 pieces."""
    order = np.argsort(np.asarray(table.column("piece")))
    counts, below = (np.sum([np.frombuffer(table.column(c)[int(i)].as_py()) for i in order], axis=0) for c in ("counts", "below"))
    ones, stop, weighted = (x[0] for x in weigh_nodes(counts[None], below[None]))
    bucket = table.column("bucket")[0].as_py()
    blobs = (squeeze(ones), squeeze(stop), counts.tobytes(), weighted.tobytes())
    return pa.table([pa.array([bucket], pa.int32()), pa.array([bucket >> 8], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], [x.split()[0] for x in CONTEXTS.split(", ")])


TOPS = "near int, counts binary, weighted binary"


def _top_sums(table: pa.Table) -> pa.Table:
    """Of the at most 256 buckets that share their nearest byte."""
    order = np.argsort(np.asarray(table.column("bucket")))
    both = [np.sum([np.frombuffer(table.column(c)[int(i)].as_py()) for i in order], axis=0).tobytes() for c in ("counts", "weighted")]
    return pa.table([pa.array([table.column("near")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in both)], ["near", "counts", "weighted"])


class Crown:
    """Depths 0 and 1: predictions and stopping weights by context byte and node (heap order)."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]) -> None:
        counts, below = np.zeros((256, 256)), np.zeros((256, 256))
        for near, c, w in rows:
            counts[near], below[near] = np.frombuffer(c), np.frombuffer(w)
        self.ones1, self.stop1, weighted = weigh_nodes(counts, below)
        ones, stop, _ = weigh_nodes(counts.sum(axis=0)[None], weighted.sum(axis=0)[None])
        self.ones0, self.stop0 = ones[0], stop[0]


def log10_probabilities(strings: np.ndarray, counts: np.ndarray, near: int, context: tuple[np.ndarray, np.ndarray], crown: Crown) -> np.ndarray:
    """log10 of the probability of each string's last byte after the bytes before it; ``context`` are the ones and stops of the bucket's own two bytes."""
    depths = DEPTH - 2
    levels = subtree(strings, counts, depths)
    out = np.zeros(len(strings))
    nxt = strings & U(255)
    places = [np.searchsorted(x.strings, ((strings >> U(8 * (depths - d))) << U(8)) | nxt) for d, x in enumerate(levels[:-1])] + [np.arange(len(strings))]
    for bit in range(8):
        one = ((nxt >> U(7 - bit)) & U(1)).astype(bool)
        p = np.full(len(strings), 0.5)
        for level, place in zip(reversed(levels), reversed(places), strict=True):
            node = level.index[bit][place]
            ones = (level.ones[bit] + 0.5) / (level.zeros[bit] + level.ones[bit] + 1)
            stop = level.stop[bit][node]
            p = stop * ones[node] + (1 - stop) * p
        heap = (U(1 << bit) | (nxt >> U(8 - bit))).astype(np.int64)
        for ones, stop in (context, (crown.ones1[near], crown.stop1[near]), (crown.ones0, crown.stop0)):
            p = stop[heap] * ones[heap] + (1 - stop[heap]) * p
        out += np.log10(np.where(one, p, 1 - p))
    return out


ANSWERS = "space int, bucket long, node long, keys binary, answers binary"


def _answers(batches: Iterator[pa.RecordBatch], crown: Crown) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, keys, counts, ones, stop in zip(*(column(batch, c).to_pylist() for c in ("bucket", "keys", "counts", "ones", "stop")), strict=True):
            found = log10_probabilities(*_piece_strings(keys, counts), bucket >> 8, (unsqueeze(ones, np.float64), unsqueeze(stop, np.float64)), crown)
            yield _columns([(GRAMS, bucket, 0, keys, squeeze(found.astype(np.float32)))], ANSWERS)


def _reply(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What a node knows of one bucket, for each of its children as far as they named it: logarithms in 32 bits, or counts in 64."""
    kind = np.float32 if known.column("space")[0].as_py() == GRAMS else np.uint64
    parts = sorted(((undeltas(k.as_py()), unsqueeze(v.as_py(), kind)) for k, v in zip(known.column("keys"), known.column("answers"), strict=True)), key=lambda x: int(x[0][0]))
    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = [(space, bucket, node, k, squeeze(values[np.searchsorted(keys, undeltas(k))])) for space, bucket, node, k in zip(*(asked.column(c).to_pylist() for c in ("space", "bucket", "node", "keys")), strict=True)]
    return pa.Table.from_batches([_columns(rows, ANSWERS)])


def _placed(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    for block, batch, _ in blocks(batches, block_bytes):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), column(batch, "doc_id"), column(batch, "text")], ["block", "doc_id", "text"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _score_block(docs: pa.Table, replies: pa.Table, tokens: int, distinct: int, trained: int) -> pa.Table:
    names = [x.split()[0] for x in SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    replies = replies.sort_by([("space", "ascending"), ("bucket", "ascending")])
    told: dict[int, list[np.ndarray]] = {GRAMS: [np.zeros(0, np.float32)], WORDS: [np.zeros(0)], DIGEST: []}
    for space, bucket, answers in zip(*(replies.column(c).to_pylist() for c in ("space", "bucket", "answers")), strict=True):
        told[space].append(bucket if space == DIGEST else unsqueeze(answers, np.float32) if space == GRAMS else unsqueeze(answers, np.uint64).astype(np.float64))
    logs_of, known_counts = np.concatenate(told[GRAMS]), np.concatenate(told[WORDS])
    parts = []
    whole = slices(docs.select(["doc_id", "text"]).combine_chunks().to_batches(), limit=SLICE_BYTES)
    for batch in (b.slice(at, SLICE_ROWS) for b in whole for at in range(0, b.num_rows, SLICE_ROWS)):  # a text's number takes 16 bits
        part = Slice(column(batch, "text").to_pylist())
        pair = np.sort((part.keys << U(16)) | part.doc.astype(np.uint64))
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(head, append=len(pair)).astype(np.int32)
        key, doc = pair[head] >> U(16), (pair[head] & U(65535)).astype(np.int32)
        new = np.append(True, key[1:] != key[:-1])
        words, at = np.unique(part.words, return_inverse=True)
        parts.append((column(batch, "doc_id").to_pylist(), part.size, key[new], (np.cumsum(new) - 1).astype(np.int32), doc, count, words, at.astype(np.int32), part.word_doc))
    grams, words = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in parts)])) for i in (2, 6))
    if told[DIGEST] != [block_digest(grams, words)]:
        raise RuntimeError("the table's blocks differ between passes; settle it before scoring")
    unit, end = np.log10(tokens + 0.1 * (distinct + 1)), np.log10(trained + 0.1)
    out = []
    for ids, size, own, at, doc, count, own_words, word_at, word_doc in parts:
        logs = logs_of[np.searchsorted(grams, own)].astype(np.float64)
        score = np.bincount(doc, weights=logs[at] * count, minlength=len(ids))
        known = known_counts[np.searchsorted(words, own_words)]
        n = np.bincount(word_doc, minlength=len(ids)) + 1
        base = np.bincount(word_doc, weights=np.log10(known + 0.1)[word_at], minlength=len(ids)) + end - n * unit
        seen = np.bincount(word_doc, weights=(known > 0)[word_at], minlength=len(ids)).astype(np.int64) + (trained > 0)
        out.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, [held_out(d) for d in ids], n, seen, np.full(len(ids), tokens), base, score, size), kinds, strict=True)], names))
    return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (code length per byte is -score * log2(10) / n_bytes).

    Null texts are empty: their one token is the end. Null ids count as held out. Ties and repeated rows are rows of
    their own; other columns are ignored; an empty table gives no rows. A very long text is a block of its own and held
    whole, about a hundred bytes for each of its own. The table must read the same way twice, as files do; settle anything
    else first (blocks carry a digest of what they ask for, so a difference is an error, not a wrong score).
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col)
    leaves = settle_table(rows.mapInArrow(lambda it: _requests(it, block_bytes), NODES))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    trained = rows.where(crc % HELD_OUT != 0).count()
    digests = leaves.where(F.col("space") == DIGEST)
    marks = digests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("node") % (1 << 24)), F.lit(0)).alias("last")).first()
    levels, widths, bits = [leaves.where(F.col("space") != DIGEST)], [marks.n], [WORD_BITS]
    while widths[-1] > 1 or len(levels) == 1:
        largest = levels[-1].where(F.col("space") == WORDS).agg(F.max(F.octet_length("keys"))).first()[0] or 0
        bits.append(min(bits[-1] + FINER_BITS, 40) if largest * MERGED_NODES > BUCKET_BYTES else bits[-1])
        widths.append(-(-widths[-1] // MERGED_NODES) or 1)
        levels.append(settle_table(_merge(_upwards(levels[-1], widths[-1]), bits[-1])))
    top = levels[-1]
    words = top.where(F.col("space") == WORDS)
    totals = words.mapInArrow(_word_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    tokens, distinct = totals[0] + trained, totals[1] + (trained > 0)
    pieces = settle_table(top.where(F.col("space") == GRAMS).mapInArrow(lambda it: _cut(it, PIECE_KEYS), PIECES))
    contexts = settle_table(pieces.mapInArrow(_sums, SUMS).groupBy("bucket").applyInArrow(_bucket_context, CONTEXTS))
    crown = Crown([tuple(r) for r in contexts.groupBy("near").applyInArrow(_top_sums, TOPS).collect()])  # at most 256 rows of fixed size
    known = settle_table(pieces.join(contexts.select("bucket", "ones", "stop"), "bucket").mapInArrow(lambda it: _answers(it, crown), ANSWERS))
    known = known.unionByName(words.withColumnRenamed("counts", "answers"))
    for level in range(len(levels) - 2, -1, -1):
        asking = _upwards(levels[level], widths[level + 1]).select("space", "bucket", "up", "node", "keys")
        coarse = F.when(F.col("space") == WORDS, F.shiftright("bucket", bits[level + 1] - bits[level])).otherwise(F.col("bucket"))
        telling = known.select("space", coarse.alias("bucket"), F.col("node").alias("up"), "keys", "answers")
        known = asking.groupBy("space", "bucket", "up").cogroup(telling.groupBy("space", "bucket", "up")).applyInArrow(_reply, ANSWERS)
    answered = known.drop("keys").unionByName(digests.select("space", "bucket", "node", F.lit(None).cast("binary").alias("answers"))).withColumnRenamed("node", "block")
    placed = rows.mapInArrow(lambda it: _placed(it, block_bytes), "block long, doc_id long, text string")
    # Blocks are numbered through, so that every partition gets as many of them as any other.
    parts = max(shuffle_partitions(spark), marks.n // 16)
    number = F.shiftright("block", 24) * (marks.last + 1) + F.col("block") % (1 << 24)
    even = lambda df: df.withColumn("part", F.pmod(number, F.lit(parts)).cast("int")).repartitionById(parts, F.col("part")).groupBy("part", "block")
    return even(placed).cogroup(even(answered)).applyInArrow(lambda a, b: _score_block(a, b, tokens, distinct, trained), SCORES)


def _upwards(nodes: DataFrame, width: int) -> DataFrame:
    """Each node with its parent, one of so many."""
    return nodes.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(width)).cast("long"))


def _merge(nodes: DataFrame, word_bits: int) -> DataFrame:
    return nodes.groupBy("space", "bucket", "up").applyInArrow(lambda t: _merged(t, word_bits), NODES)


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [unsqueeze(x, np.uint64) for x in column(batch, "counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "v"])
