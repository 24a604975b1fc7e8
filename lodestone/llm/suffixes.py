"""Removal of long repeated strings by a distributed, sampled suffix array.

Every 200-byte window holds one sample point that depends on its bytes alone: where its 64-byte string of least name
starts (leftmost on ties). Equal windows have their sample point at the same place, so only the suffixes that start at
sample points are sorted. A suffix's tokens are its leading bytes, eight to a token, then the name of its first 64 bytes,
then that of the whole stretch of text whose windows share the point.

Suffixes are range-partitioned by splitters taken from a sorted sample (about one document in 32), which compare all
tokens, so that every bucket is small whatever is frequent: equal leading tokens are split by later ones, and wholly equal
suffixes that fill several buckets are spread over them. A bucket sorts its suffixes by multikey quicksort, compares
neighbours, and compares across its boundaries: a splitter is a suffix of the text itself, so what is equal to a splitter
that was drawn twice repeats whichever bucket it lies in, and what shares its first 64 bytes with a splitter may go on
beyond the boundary and is passed on to the second comparison.

Suffixes that agree in all tokens repeat as a whole. Of those that share the first 64 bytes only, one stretch for each
distinct last token meets the others, and there bytes decide: the stretches are sorted by what follows the sample point
and, reversed, by what precedes it, neighbours' common prefixes are counted, and a window repeats if some other stretch
shares enough bytes on both sides. A string of 64 bytes that has more than MOST_STRETCHES of them (or may have, lying in
several buckets) isn't gathered: its windows become suffixes of their own and pass through the same sort, where only whole
ones count.

Texts are shuffled once; only the texts that have such stretches wait for the second comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import RollingHash, U, clear_tables, column, keyed_text, partial_batch, settle_table, shuffle_partitions, slices, utf8

WIDTH = 200
NAME = 64
#: Suffixes in a bucket, and how many buckets there are at most: a splitter takes 48 bytes in every task.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 1 << 20
SAMPLE = 32
#: Stretches of one first string that are compared together, and bytes of stretches in a group of such strings.
MOST_STRETCHES = 16_384
GROUP_BYTES = 2 << 20
#: Bytes of one long text that numpy holds at a time.
PIECE = 4 << 20
#: Stands for a null id in keys; tags tell such rows from rows that have this id.
NO_ID = -(2**63)
_PLACE = 30  # bits for a place in one slice of text
LEAD = 4
KEYS = [*(f"t{i}" for i in range(LEAD)), "name", "rest"]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def leading_tokens(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first LEAD tokens of the suffixes at these places, as signed numbers in the order of their bytes."""
    words = raw[at[:, None] + np.arange(8 * LEAD)].view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(w).view(np.int64) ^ np.int64(NO_ID) for w in words.T]


def stretch_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Names of byte ranges, together with where the sample point lies in them."""
    data, digest = memoryview(raw.tobytes()), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), left.tolist(), strict=True)), np.uint64, len(start)).view(np.int64)


def sample_points(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, name: int = NAME) -> dict[str, np.ndarray]:
    """Runs of windows that share a sample point: document, first window's start in it, windows, the point's place in the first one, and the tokens."""
    plain = ("doc", "start", "count", "left")
    windows = np.arange(max(0, len(raw) - width + 1))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(windows)]
    whole = windows + width <= offsets[1:][of]
    if not whole.any():
        return {k: np.zeros(0, np.int64) for k in (*plain, *KEYS)}
    names = RollingHash(raw).windows(name)
    place = np.arange(len(names), dtype=np.uint64)
    point = (sliding_least(names >> U(_PLACE) << U(_PLACE) | place, width - name + 1) & U((1 << _PLACE) - 1)).astype(np.int64)
    windows, point, of = windows[whole], point[whole], of[whole]
    head = np.append(True, (point[1:] != point[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(head)
    count = np.diff(at, append=len(windows))
    start, where = windows[at], point[at]
    values = [of[at], start - offsets[:-1][of[at]], count, where - start, *leading_tokens(raw, where), names[where].view(np.int64), stretch_names(raw, start, start + count - 1 + width, where - start)]
    return dict(zip((*plain, *KEYS), values, strict=True))


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order by the first token, then the next; each token is looked at only where all before it are tied."""
    order = np.argsort(tokens[0], kind="quicksort")
    same = np.diff(tokens[0][order]) == 0
    for token in tokens[1:]:
        if not same.any():
            break
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        group = np.cumsum(~np.append(False, same)[tied])
        sub = order[tied]
        sub = sub[np.lexsort((token[sub], group))]
        order[tied] = sub
        same[tied[1:] - 1] = (np.diff(tied) == 1) & (np.diff(group) == 0) & (np.diff(token[sub]) == 0)
    return order


def as_strings(keys: list[np.ndarray]) -> np.ndarray:
    """All tokens of each suffix as one byte string in the same order."""
    wide = np.column_stack([(np.ascontiguousarray(k) ^ np.int64(NO_ID)).view(np.uint64) for k in keys]).astype(">u8")
    return wide.view(f"S{8 * len(keys)}").reshape(-1)


def place_in_buckets(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """The bucket of each suffix, ``splitters`` being rows of tokens; those equal to several splitters are spread over the buckets around them."""
    low, high = np.searchsorted(splitters[:, 0], keys[0], "left"), np.searchsorted(splitters[:, 0], keys[0], "right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        own, cuts = as_strings([k[tied] for k in keys]), as_strings(list(splitters.T))
        low[tied], high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
        several = high - low[tied] > 1
        low[tied] += np.where(several, np.arange(len(tied)) % (high - low[tied] + 1), 0)
    return low


_POINTS = ["bucket", *KEYS, "doc_id", "tag", "start", "count", "left"]
POINTS = "bucket int, " + "".join(f"{k} long, " for k in KEYS) + "doc_id long, tag long, start int, count int, left int"
KEY_ROWS = ", ".join(f"{k} long" for k in KEYS)


def _points(batches: Iterator[pa.RecordBatch], splitters: np.ndarray | None, width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        raw, offsets = utf8(column(batch, "text"))
        for at in range(0, max(1, len(raw)), PIECE) if batch.num_rows == 1 else (0,):
            end = min(len(raw), at + PIECE + width - 1) if batch.num_rows == 1 else len(raw)
            p = sample_points(raw[at:end], np.array([0, end - at]) if batch.num_rows == 1 else offsets, width)
            if splitters is None:
                yield pa.RecordBatch.from_arrays([pa.array(p[k]) for k in KEYS], KEYS)
                continue
            rows = pa.array(p["doc"])
            bucket = place_in_buckets([p[k] for k in KEYS], splitters)
            small = [pa.array(x.astype(np.int32)) for x in (bucket, p["start"] + at, p["count"], p["left"])]
            yield pa.RecordBatch.from_arrays([small[0], *(pa.array(p[k]) for k in KEYS), column(batch, "doc_id").take(rows), column(batch, "tag").take(rows), *small[1:]], _POINTS)


COMPARED = "name long, doc_id long, tag long, start int, count int, left int, whole boolean, partly boolean, lead boolean, hot boolean"


def compare_bucket(table: dict[str, np.ndarray], splitters: np.ndarray, most: int, usual: int) -> dict[str, np.ndarray]:
    """Sort one bucket, compare neighbours and the splitters at its ends: the suffixes that repeat as a whole, or share their first 64 bytes, with each distinct one's first row.

    ``usual`` is how many suffixes a bucket has. What several buckets hold of one first string is taken for as many suffixes
    as they may have, so that all of them decide alike whether it has more than ``most``.
    """
    order = multikey_order([table[k] for k in KEYS])
    keys = np.column_stack([table[k][order] for k in KEYS])
    new = np.vstack([np.ones(len(KEYS), bool), keys[1:] != keys[:-1]])
    new_f, new_s = new[:, :-1].any(axis=1), new.any(axis=1)
    suffix, group = np.cumsum(new_s) - 1, np.cumsum(new_f) - 1
    distinct = np.bincount(group[new_s])
    whole, edge, hot = np.bincount(suffix)[suffix] > 1, np.zeros(len(order), bool), np.zeros(len(order), bool)
    bucket = int(table["bucket"][0])
    for i in (bucket - 1, bucket):
        if 0 <= i < len(splitters):
            like = keys == splitters[i]
            begins = like[:, :-1].all(axis=1)
            edge |= begins
            if 2 * usual * (1 + int((splitters[:, :-1] == splitters[i, :-1]).all(axis=1).sum())) > most:
                hot |= begins
            if (splitters[max(0, i - 1) : i + 2] == splitters[i]).all(axis=1).sum() > 1:
                whole |= like.all(axis=1)
    partly = edge | (distinct[group] > 1)
    kept = np.flatnonzero(whole | partly)
    out = {"name": keys[kept, -2], **{c: table[c][order][kept] for c in ("doc_id", "tag", "start", "count", "left")}}
    return out | {"whole": whole[kept], "partly": partly[kept], "lead": new_s[kept], "hot": (hot | ~edge & (distinct[group] > most))[kept]}


def _compared(splitters: np.ndarray, most: int, usual: int):
    def one(table: pa.Table) -> pa.Table:
        got = compare_bucket({c: np.asarray(table.column(c)) for c in table.column_names}, splitters, most, usual)
        names = [x.split()[0] for x in COMPARED.split(", ")]
        return pa.table([pa.array(got[c]) for c in names], names)

    return one


def _every(batches: Iterator[pa.RecordBatch], stride: int) -> Iterator[pa.RecordBatch]:
    seen = -(stride // 2)
    for batch in batches:
        picks = np.arange(-seen % stride, batch.num_rows, stride)
        seen += batch.num_rows
        yield batch.take(pa.array(picks))


def choose_splitters(sample: DataFrame, scale: int) -> tuple[np.ndarray, int]:
    """Splitters, as rows of tokens, from a settled sample of suffixes that stands for ``scale`` times as many, and how many those are for each bucket.

    There is a bucket for each BUCKET_ROWS suffixes, at least two for each shuffle partition and at most MOST_BUCKETS; the
    sample is sorted as a table and only the splitters come to the driver.
    """
    n = sample.count()
    buckets = min(MOST_BUCKETS, n, max(-(-n * scale // BUCKET_ROWS), 2 * shuffle_partitions(sample.sparkSession)))
    if buckets < 2:
        return np.zeros((0, len(KEYS)), np.int64), n * scale
    parts, stride = -(-buckets // 8), -(-n // buckets)
    keys = [*KEYS, "nth"]  # equal suffixes are spread, too
    ordered = sample.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    picked = ordered.select(*KEYS).mapInArrow(lambda it: _every(it, stride), KEY_ROWS).toArrow()
    rows = [np.asarray(picked.column(k)) for k in KEYS]
    return np.column_stack(rows)[np.lexsort(rows[::-1])], stride * scale


def mark_repeats(points: DataFrame, splitters: np.ndarray, usual: int, paths: list[str]) -> DataFrame:
    """Of suffixes that lie in buckets, those that repeat or may: name, doc_id, tag, start, count, left, whole, partly, lead, hot. They are settled, which ends the shuffle of all suffixes."""
    buckets = len(splitters) + 1
    parts = min(buckets, max(shuffle_partitions(points.sparkSession), buckets // 64))
    dealt = points.withColumn("part", F.floor(F.col("bucket") * F.lit(parts) / F.lit(buckets)).cast("int")).repartitionById(parts, F.col("part"))
    return settle_table(dealt.groupBy("part", "bucket").applyInArrow(_compared(splitters, MOST_STRETCHES, usual), COMPARED), paths)


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESOLVED = f"kind int, doc_id long, tag long, {DIGEST}, text binary, runs binary, start int, left int, {KEY_ROWS}"


def digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """Bytes, removed bytes, maximal removed runs, the digest of what is kept, and what is kept."""
    if not len(starts):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
    level = np.zeros(len(text) + 1, np.int32)
    np.add.at(level, starts, 1)
    np.add.at(level, ends, -1)
    gone = np.cumsum(level[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), len(text) - len(kept), int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept


def _resolve(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Finished documents (kind 0), documents that wait (1), and the stretches (2) and windows (3) they wait for."""
    for batch in slices(batches, limit=1 << 20):
        done, waiting, stretches = [], [], []
        for doc_id, tag, text, found in zip(column(batch, "doc_id").to_pylist(), column(batch, "tag").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), column(batch, "found"), strict=True):
            runs = np.zeros((0, 2), np.int64)
            waits = False
            key = NO_ID if doc_id is None else doc_id
            if found.is_valid:
                start, count, left, name, whole, open_, hot = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in found.values.flatten())
                runs = np.column_stack([start, start + count - 1 + width])[whole].astype(np.int64)
                waits = bool(open_.any())
                cold = open_ & ~hot
                stretches += [(key, tag, text[a : a + n - 1 + width], a, s, f) for a, n, s, f in zip(start[cold].tolist(), count[cold].tolist(), left[cold].tolist(), name[cold].tolist(), strict=True)]
                yield from _window_rows(key, tag, np.frombuffer(text, np.uint8), start[open_ & hot], count[open_ & hot], width)
            if waits:
                waiting.append((doc_id, tag, text, runs.tobytes()))
            else:
                done.append((doc_id, tag, *digest(text, runs[:, 0], runs[:, 1])[:4]))
        columns = lambda rows, *kinds: (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))
        long, kind = pa.int64(), lambda n, k: pa.array(np.full(n, k, np.int32))
        if done:
            given = dict(zip(("doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns(done, long, long, long, long, long, pa.string()), strict=True))
            yield partial_batch(RESOLVED, len(done), kind=kind(len(done), 0), **given)
        if waiting:
            given = dict(zip(("doc_id", "tag", "text", "runs"), columns(waiting, long, long, pa.binary(), pa.binary()), strict=True))
            yield partial_batch(RESOLVED, len(waiting), kind=kind(len(waiting), 1), **given)
        if stretches:
            given = dict(zip(("doc_id", "tag", "text", "start", "left", "name"), columns(stretches, long, long, pa.binary(), pa.int32(), pa.int32(), long), strict=True))
            yield partial_batch(RESOLVED, len(stretches), kind=kind(len(stretches), 2), **given)


def _window_rows(key: int, tag: int, raw: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Each window of these stretches as a suffix of its own."""
    order = np.argsort(start)
    start, count = start[order], count[order]
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    for i in range(0, len(at), PIECE // 16):
        some = at[i : i + PIECE // 16].astype(np.int64)
        base, part = int(some[0]), raw[some[0] : some[-1] + width]
        own = some - base
        keys = [*leading_tokens(part, own), RollingHash(part).ranges(own, own + width).view(np.int64), stretch_names(part, own, own + width, np.zeros_like(own))]
        same = {c: pa.array(np.full(len(own), x)) for c, x in (("doc_id", key), ("tag", tag))}
        yield partial_batch(RESOLVED, len(own), kind=pa.array(np.full(len(own), 3, np.int32)), start=pa.array(some.astype(np.int32)), **same, **dict(zip(KEYS, map(pa.array, keys), strict=True)))


RUNS = "doc_id long, tag long, start int, count int"


def context_order(name: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes within each name, and how many leading bytes each shares with the one before it (-1: another name)."""
    order = multikey_order([name, *(np.ascontiguousarray(w) for w in context.view(">u8").astype(np.uint64).T)])
    ordered = context[order]
    common = np.full(len(order), -1)
    if len(order) > 1:
        same = ordered[1:] == ordered[:-1]
        common[1:] = np.where(same.all(axis=1), context.shape[1], same.argmin(axis=1))
        common[1:][name[order][1:] != name[order][:-1]] = -1
    return order, common


def shared_windows(raw: np.ndarray, offsets: np.ndarray, left: np.ndarray, name: np.ndarray, width: int) -> np.ndarray:
    """Whether each window of these stretches is equal to another one, decided by their bytes.

    Equal windows lie alike around their sample points. So at each distance d of the point from the window's start, windows
    are equal if d bytes before and width - d bytes after the point are; both follow from the common prefixes of neighbours
    in the order of what comes after the points, and of what comes before them, read backwards.
    """
    size = np.diff(offsets)
    count = size - width + 1
    point, reach = offsets[:-1] + left, width - NAME
    pad = lambda n: np.arange(-(-n // 8) * 8)
    ahead, behind = pad(width), pad(reach)
    after = np.where(ahead < (size - left)[:, None], raw[np.minimum(point[:, None] + ahead, len(raw) - 1)], 0).astype(np.uint8)
    before = np.where(behind < left[:, None], raw[np.maximum(point[:, None] - 1 - behind, 0)], 0).astype(np.uint8)
    (by_after, after_common), (by_before, before_common) = context_order(name, after), context_order(name, before)
    begin = np.cumsum(count) - count
    found = np.zeros(int(count.sum()), bool)
    classes = np.empty((2, len(size)), np.int64)
    for d in range(reach + 1):
        rows = np.flatnonzero((d <= left) & (d > left - count))
        if len(rows) < 2:
            continue
        classes[0, by_after] = np.cumsum(after_common < width - d)
        classes[1, by_before] = np.cumsum(before_common < d)
        key = classes[0, rows] * (len(size) + 1) + classes[1, rows]
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        again = rows[order[np.append(False, same) | np.append(same, False)]]
        found[begin[again] + left[again] - d] = True
    return found


def _compare_stretches(table: pa.Table, width: int) -> pa.Table:
    """Runs of windows of stretches that are equal to another window of the group."""
    raw, offsets = utf8(table.column("text").combine_chunks())
    lengths = np.diff(offsets) - width + 1
    begin = np.cumsum(lengths) - lengths
    again = shared_windows(raw, offsets, np.asarray(table.column("left")).astype(np.int64), np.asarray(table.column("name")), width)
    flag = again.astype(np.int8)
    heads = np.append(True, flag[1:] != flag[:-1])
    heads[begin] = True
    first = np.flatnonzero(heads)
    count = np.diff(first, append=len(again))[again[first]]
    first = first[again[first]]
    row = np.searchsorted(begin, first, side="right") - 1
    start = np.asarray(table.column("start"))[row] + first - begin[row]
    return pa.table([table.column("doc_id").take(pa.array(row)), table.column("tag").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], [x.split()[0] for x in RUNS.split(", ")])


def _finish(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        out = []
        for text, runs, at in zip(column(batch, "text").to_pylist(), column(batch, "runs").to_pylist(), column(batch, "at"), strict=True):
            start, count = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in at.values.flatten()) if at.is_valid else np.zeros((2, 0), np.int64)
            known = np.frombuffer(runs, np.int64).reshape(-1, 2)
            out.append(digest(text, np.concatenate([known[:, 0], start]), np.concatenate([known[:, 1], start + count - 1 + width]))[:4])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))])


def _bucketed(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket = place_in_buckets([column(batch, k).to_numpy() for k in KEYS], splitters)
        ones = pa.array(np.ones(batch.num_rows, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(column(batch, c) for c in _POINTS[1:-2]), ones, ones], _POINTS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each byte goes that a ``width``-byte string covers which starts twice or more anywhere.

    Matches lie within one text; overlaps within a text count. Null and empty texts, and texts shorter than ``width``,
    keep all their bytes. Repeated rows are documents of their own and so repeat each other. Null ids keep their rows;
    ties don't matter; other columns are ignored; an empty table gives no rows. A very long text is sampled in pieces that
    overlap by a window, so its matches are whole.
    """
    if width <= NAME:
        raise ValueError(f"strings must be longer than {NAME} bytes")
    spark, paths = docs.sparkSession, []
    # Rows that agree in id and text get the same answer, so the pair serves as their key.
    rows = keyed_text(docs, id_col, text_col).select("doc_id", F.xxhash64(F.lit(3), "doc_id", "text").alias("tag"), "text")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    same = (key == F.col("its_id")) & (F.col("tag") == F.col("its_tag"))
    long_ = rows.where(F.octet_length("text") >= width).withColumn("doc_id", key)
    sampled = settle_table(long_.where(F.pmod(F.xxhash64(F.lit(5), "tag"), F.lit(SAMPLE)) == 0).mapInArrow(lambda it: _points(it, None, width), KEY_ROWS), paths)
    splitters, usual = choose_splitters(sampled, SAMPLE)
    points = long_.mapInArrow(lambda it: _points(it, splitters, width), POINTS)
    marked = mark_repeats(points, splitters, usual, paths)
    found = marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "count", "left", "name", "whole", (F.col("partly") & F.col("lead")).alias("open"), "hot")).alias("found"))
    found = found.withColumnsRenamed({"doc_id": "its_id", "tag": "its_tag"})
    joined = rows.join(found, same, "left").select("doc_id", "tag", "text", "found")
    resolved = settle_table(joined.mapInArrow(lambda it: _resolve(it, width), RESOLVED))
    clear_tables(spark, paths)
    digests = ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))]
    stretches = resolved.where("kind = 2").select("doc_id", "tag", "text", "name", "start", "left")
    groups = max(shuffle_partitions(spark), -(-(stretches.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // GROUP_BYTES))
    grouped = stretches.groupBy(F.pmod(F.xxhash64("name"), F.lit(groups)).alias("group"))
    near = grouped.applyInArrow(lambda t: _compare_stretches(t, width), RUNS)
    windows = resolved.where("kind = 3").select(*KEYS, "doc_id", "tag", "start")
    second_splitters, second_usual = choose_splitters(settle_table(windows.where(F.pmod(F.xxhash64(F.lit(5), "tag", "start"), F.lit(SAMPLE)) == 0).select(*KEYS)), SAMPLE)
    again = mark_repeats(windows.mapInArrow(lambda it: _bucketed(it, second_splitters), POINTS), second_splitters, second_usual, []).where("whole")
    runs = near.unionByName(again.select("doc_id", "tag", "start", "count"))
    at = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("at")).withColumnsRenamed({"doc_id": "its_id", "tag": "its_tag"})
    waiting = resolved.where("kind = 1").select("doc_id", "tag", "text", "runs").join(at, same, "left").select("doc_id", "text", "runs", "at")
    return resolved.where("kind = 0").select(digests).unionByName(waiting.mapInArrow(lambda it: _finish(it, width), f"doc_id long, {DIGEST}"))


#: What ``remove_repeats`` returns, by counting every window; for small tables (the windows are cut from pieces of 1,000 bytes).
ORACLE_SQL = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, b, substr(h, CAST(b * 2000 + 1 AS BIGINT), 2398) AS piece, len(h) // 2 AS n FROM texts, unnest(range(0, greatest(0, len(h) // 2 - 199), 1000)) u(x), LATERAL (SELECT x // 1000 AS b)),
windows AS (SELECT r, b * 1000 + i AS pos, md5(substr(piece, CAST(2 * i + 1 AS BIGINT), 400)) AS name FROM parts, unnest(range(0, least(1000, n - 199 - b * 1000))) u(i)),
again AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY name) > 1),
heads AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS head FROM again),
runs AS (SELECT r, min(pos) AS a, max(pos) + 200 AS z FROM (SELECT r, pos, sum(head) OVER (PARTITION BY r ORDER BY pos) AS run FROM heads) GROUP BY r, run),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS open FROM runs),
kept AS (SELECT t.r, string_agg(substr(h, CAST(2 * open + 1 AS BIGINT), CAST(2 * (a - open) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT)) AS k, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM texts t JOIN gaps USING (r) GROUP BY t.r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""
