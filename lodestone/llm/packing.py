"""Packing documents into token sequences by non-negative least squares over length combinations.

A task tokenises its own split and packs it block by block (``block_tokens`` ids at a time), so nothing is shuffled, a
task holds one block, and a lost executor costs only the splits it was working on. Inside a block:

1. full windows are cut off long documents, what is left of each document falls into one of 32 length bins;
2. every combination of at most four bins that fills a window is a column of a small matrix, and non-negative least
   squares gives the repeat counts of the combinations whose sum comes nearest to the block's length histogram;
3. the counts are rounded and the combinations laid out while their bins last;
4. residual documents are cut greedily into the slack of those sequences, then into windows of their own, and the last
   few ids go to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import column, keyed_text, slices

#: Fixed values of the contract: the longest sequence and the id that ends a document.
WINDOW = 4096
END_ID = 2
BINS = 32
PARTS = 4

_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where visible, else one from 256 on, in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


@functools.cache
def _tokenizer(path: str):
    """Loaded once in a worker process; caches of words belong to a task and go with it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Ids of texts by a tokenizer that drops white space, word by word through a bounded cache.

    White space parts tokens in this tokenizer, so a text's ids are its words' ids in order. A word of plain letters
    with closing punctuation is looked up in two parts, which go to the tokenizer's model directly; any other word goes
    through the whole tokenizer. The cache (little-endian 32-bit ids by word) is emptied when it holds ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.limit = limit
        self._model = self.tokenizer.model
        self._letters = _byte_letters()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _token(self, piece: str) -> bytes:
        """Ids of one lower-case pre-token."""
        if not piece.isascii():
            piece = "".join([self._letters[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(piece)])

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if not core.isalpha() or not (core.isascii() or max(core) <= "ÿ"):
            ids = self._encode(word)
        elif (low := core.lower()) == word:
            ids = self._token(word)
        else:
            ids = self[low] + self[word[len(core) :]] if len(core) < len(word) else self[low]
        self[word] = ids
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self) > self.limit:
            self.clear()
        get, out = self.__getitem__, []
        for text in texts:
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # Python splits there, the tokenizer doesn't
                out.append(self._encode(text))
            else:
                out.append(b"".join(map(get, text.split())))
        return out


@functools.cache
def combinations(bins: int = BINS, parts: int = PARTS) -> np.ndarray:
    """Columns: how often each bin (of 1 to ``bins`` units) occurs in a combination of at most ``parts`` that fills the window."""
    found: list[list[int]] = []

    def grow(have: list[int], left: int) -> None:
        if not left:
            found.append(have)
        elif len(have) < parts:
            for b in range(1, min(left, have[-1] if have else bins) + 1):
                grow([*have, b], left - b)

    grow([], bins)
    a = np.zeros((bins, len(found)))
    for j, combo in enumerate(found):
        np.add.at(a[:, j], np.array(combo) - 1, 1)
    return a


def nonnegative_least_squares(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Least ||a x - h|| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(3 * n):
        gain = a.T @ (h - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        free[best] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], h, rcond=None)[0]
            if (trial[free] > 0).all():
                x = trial
                break
            bad = free & (trial <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300))
            x = x + step * (trial - x)
            free &= x > tolerance
            x[~free] = 0
            if not free.any():
                break
    return x


def pack(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document's index, start, length, sequence, offset); sequences are full or have a power of two of ids.

    Documents of no ids have no pieces.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    unit = window // BINS
    pools: list[deque] = [deque() for _ in range(BINS)]
    for d, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((d, k * window, window, seq, 0))
            seq += 1
        if n % window:
            pools[(n % window - 1) // unit].append((d, n - n % window, n % window))
    a = combinations()
    counts = np.rint(nonnegative_least_squares(a, np.array([len(p) for p in pools], float))).astype(int)
    laid: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-counts, kind="stable"):
        if not counts[j]:
            break
        uses = [(b, int(a[b, j])) for b in np.flatnonzero(a[:, j])]
        times = min(int(counts[j]), *(len(pools[b]) // k for b, k in uses))
        laid += [[pools[b].popleft() for b, k in uses for _ in range(k)] for _ in range(times)]
    rest = deque(sorted((x for p in pools for x in p), key=lambda x: -x[2]))
    slack = deque(laid)
    while slack:
        items = slack.popleft()
        left = window - sum(x[2] for x in items)
        while left and (rest or slack):
            if not rest:
                rest.extend(slack.pop())
            d, start, n = rest.popleft()
            items.append((d, start, min(n, left)))
            if n > left:
                rest.appendleft((d, start + left, n - left))
            left -= min(n, left)
        if left:  # the last one: its ids close the block
            rest.extend(items)
            continue
        at = 0
        for d, start, n in items:
            pieces.append((d, start, n, seq, at))
            at += n
        seq += 1
    total = sum(x[2] for x in rest)
    sizes = [window] * (total // window) + [1 << k for k in reversed(range(window.bit_length() - 1)) if total % window >> k & 1]
    for size in sizes:
        at = 0
        while at < size:
            d, start, n = rest.popleft()
            take = min(n, size - at)
            pieces.append((d, start, take, seq, at))
            if n > take:
                rest.appendleft((d, start + take, n - take))
            at += take
        seq += 1
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _block(docs: list[tuple[int | None, bytes]], first: int, keep_ids: bool) -> tuple[pa.RecordBatch, int]:
    pieces = pack([len(x) // 4 for _, x in docs])
    rows = [(docs[d][0], s, n, zlib.crc32(ids := docs[d][1][4 * s : 4 * (s + n)]), len(docs[d][1]) // 4, first + q, o, *([np.frombuffer(ids, "<i4")] if keep_ids else [])) for d, s, n, q, o in pieces]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names + ["ids"] * keep_ids), first + (max((p[3] for p in pieces), default=-1) + 1)


def _rows(batches: Iterator[pa.RecordBatch], tokenizer: str, block_tokens: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = WordIds(tokenizer)
    end = np.array([END_ID], "<u4").tobytes()
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for batch in slices(batches, limit=1 << 20):
        for doc, ids in zip(column(batch, "doc_id").to_pylist(), encoder.ids(column(batch, "text").to_pylist()), strict=True):
            held.append((doc, ids + end))
            size += len(ids) // 4 + 1
        if size >= block_tokens:
            out, first = _block(held, first, keep_ids)
            yield out
            held, size = [], 0
    if held:
        yield _block(held, first, keep_ids)[0]


def pack_documents(docs: DataFrame, tokenizer: str, block_tokens: int = 4 << 20, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence; ``keep_ids`` adds the piece's ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. Null and empty texts have the end id
    alone; a very long text is cut into many pieces, and its ids (four bytes each) are held whole while its block is packed.
    Null ids, ties and repeated rows are packed like any other row; other columns are ignored; an empty table
    gives no rows. Sequence ids are unique but not consecutive: the split's number above, a count within it below.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(lambda it: _rows(it, tokenizer, block_tokens, keep_ids), SCHEMA + (", ids array<int>" if keep_ids else ""))
