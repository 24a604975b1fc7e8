"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are computed in one pass over the texts; from then on only distinct 64-bit values move. If two values
differ in at most ``radius`` of 64 bits cut into m segments on a ring, then from some segment on every chain of l
consecutive segments has at most l * radius / m differing bits in all. For the first chain lengths that budget is below
one, so those segments are equal: they are the key by which values meet. Inside a bucket pairs must keep the budgets of
all longer chains before the full Hamming check. A bucket yields a spanning forest, never its pairs.

Buckets of more than ``MAX_BUCKET`` values aren't compared pairwise: each value sends its ball of radius one instead
(65 keys); two values within two bits share one of them, and values that share a key are within two bits, so the links
are the same. Both ways are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import U, clear_tables, column, gather, keyed_text, settle, settle_table, slices

SEED = 42
RADIUS = 2
SEGMENTS = 8
MAX_BUCKET = 512


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text's shingles of ``width`` lower-cased words (A-Z only), repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < width:
        starts, stops = [0], [len(joined)]
    else:
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 18):
        part = hashes[i : i + (1 << 18)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = np.array([fingerprint(t, width) for t in column(batch, "text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    return keyed_text(docs, id_col, text_col).mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


class _Forest:
    """Union-find over positions; the smaller position becomes the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def chain_key_length(radius: int, segments: int) -> int:
    """How many consecutive segments must be equal: the chains whose budget is below one differing bit."""
    n = next(k for k in range(1, segments + 1) if k * radius >= segments) - 1
    if n < 1:
        raise ValueError("more segments than differing bits are needed")
    return n


def pigeonring_pairs(values: np.ndarray, start: int, radius: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a bucket whose chains from ``start`` keep every budget and that differ in at most ``radius`` bits."""
    i, j = np.triu_indices(len(values), 1)
    diff = values[i] ^ values[j]
    width = 64 // segments
    total = np.zeros(len(diff), np.int64)
    alive = np.ones(len(diff), bool)
    for k in range(segments):
        shift = np.uint64(64 - width * ((start + k) % segments + 1))
        total += np.bitwise_count((diff >> shift) & np.uint64((1 << width) - 1))
        alive &= total * segments <= (k + 1) * radius
    alive &= np.bitwise_count(diff) <= radius
    return i[alive], j[alive]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, segments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [], []
        for start, fps in zip(column(batch, "start").to_pylist(), column(batch, "fps"), strict=True):
            values = np.sort(np.asarray(fps.values))
            forest = _Forest(len(values))
            for i, j in zip(*(x.tolist() for x in pigeonring_pairs(values.view(np.uint64), start, radius, segments)), strict=True):
                forest.join(i, j)
            root = np.array([forest.root(i) for i in range(len(values))])
            linked = np.flatnonzero(root != np.arange(len(values)))
            src.append(values[linked])
            dst.append(values[root[linked]])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["a", "b"])


def segments_for(n: int, radius: int = RADIUS) -> int:
    """Segments whose keys are long enough that n random values fill buckets by a quarter of ``MAX_BUCKET`` at most, 32 beyond that."""
    return next((m for m in (SEGMENTS, 16) if n <= MAX_BUCKET // 4 << chain_key_length(radius, m) * 64 // m), 32)


def link_values(values: DataFrame, radius: int = RADIUS, segments: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) among the distinct values of column ``fp``, enough to connect all that are within ``radius`` bits.

    Without ``segments``, their number follows from that of the values: longer keys for more of them.
    """
    segments = segments or segments_for(values.count(), radius)
    if 64 % segments or radius not in (1, 2):
        raise ValueError("segments must divide 64, and the exact way for large buckets serves a radius of 1 or 2")
    width, chain = 64 // segments, chain_key_length(radius, segments)
    ring = F.concat(F.lpad(F.conv(F.hex("fp"), 16, 2), 64, "0"), F.lpad(F.conv(F.hex("fp"), 16, 2), 64, "0"))
    keyed = values.withColumn("bits", ring).select("fp", F.posexplode(F.array([F.expr(f"cast(conv(substring(bits, {1 + width * s}, {width * chain}), 2, 10) as long)") for s in range(segments)])).alias("start", "key"))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle(keyed.join(sizes, ["start", "key"]))
    small = members.where(F.col("n") <= max_bucket).groupBy("start", "key").agg(F.collect_list("fp").alias("fps")).select("start", "fps")
    links = small.mapInArrow(lambda it: _bucket_links(it, radius, segments), "a long, b long")
    large = members.where(F.col("n") > max_bucket).select("fp").distinct()
    flips = "transform(sequence(0, 63), i -> fp ^ shiftleft(cast(1 as bigint), i))"
    if radius == 1:  # a value links to its neighbours themselves
        near = large.select("fp", F.explode(F.expr(flips)).alias("b"))
        return links.union(near.join(large.select(F.col("fp").alias("b")), "b", "left_semi").select(F.col("fp").alias("a"), "b"))
    large = large.select("fp", F.explode(F.expr(f"concat(array(fp), {flips})")).alias("key"))
    least = large.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return links.union(large.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (column(batch, n).to_numpy() for n in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = _Forest(len(nodes))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(i, j)
        root = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
        kept = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[root[kept]])], ["a", "b"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that links reach from each node that has a link.

    Large-star and small-star rounds, each a shuffle by node with minima combined before it, until the links are stars.
    Links are first shrunk to forests inside their partitions. Every round is settled in the shared folder.
    """
    edges = settle(links.mapInArrow(_shrink, "a long, b long").distinct())
    n = edges.count()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = settle(gather(small, 2 * n))
        roots = new.select(F.col("b").alias("a")).distinct()
        if new.count() == new.select("a").distinct().count() and new.join(roots, "a", "left_semi").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
        edges = new
    raise RuntimeError("links didn't settle")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, segments: int | None = None, max_bucket: int = MAX_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by chains of fingerprints within ``radius`` bits.

    Null and wordless texts have fingerprint zero and are linked like any other; a very long text is held whole, with eight
    bytes for each of its shingles. Null ids keep their rows; the component of rows that all have null ids is null.
    Repeated rows and ties stay, one row out for each row in. Other columns are ignored. An empty table gives no rows.
    """
    rows = settle(fingerprints(docs, width, id_col, text_col))
    values = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(link_values(values.select("fp"), radius, segments, max_bucket))
    rooted = values.join(found, values.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Long words of a shingle set's sketch, each bit the parity of the shingles that fall on it.
SKETCH_WORDS = 16
#: Shingles are counted in one of so many sets; the most frequent ones of at least so many come last in prefixes.
SAMPLE, SAMPLE_LEAST, MAX_COMMON = 16, 4, 1 << 15


def shingle_set(text: str, width: int) -> set[int]:
    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return {digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))} if words else set()


def shingle_array(text: str, width: int) -> np.ndarray:
    """The distinct shingles in ascending order."""
    found = shingle_set(text, width)
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


PROFILE = "doc_id long, tag long, set long, fp long, n long, sketch array<long>"


def _profiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text").to_pylist()
        fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
        names, sizes, sketches = [], [], np.zeros((len(texts), SKETCH_WORDS), np.int64)
        for i, text in enumerate(texts):
            own = shingle_array(text, width)
            names.append(set_name(own))
            sizes.append(len(own))
            odd = np.bincount((own % U(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
            sketches[i] = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SKETCH_WORDS)
        values = [column(batch, "doc_id"), column(batch, "tag"), pa.array(np.array(names, np.int64)), pa.array(fps), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sketches.ravel()))]
        yield pa.RecordBatch.from_arrays(values, [x.split()[0] for x in PROFILE.split(", ")])


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The different texts of a task, by slices."""
    seen: set[int] = set()
    for batch in slices(batches):
        texts = []
        for tag, text in zip(column(batch, "tag").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            if tag not in seen:
                seen.add(tag)
                texts.append(text)
        yield texts


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for texts in _each_once(batches):
        own = np.concatenate([np.zeros(0, np.uint64), *(shingle_array(t, width) for t in texts)])
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["shingle"])


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of a sample of texts, rarest first. They only order prefixes: results don't depend on the choice."""
    sampled = rows.where(F.pmod("tag", F.lit(SAMPLE)) == 0).select("tag", "text").mapInArrow(lambda it: _shingles(it, width), "shingle long")
    counts = sampled.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_LEAST)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).collect()
    return np.array([r.shingle for r in reversed(top)], np.int64).view(np.uint64)


PREFIX = "key long, set long, n long, place long"


def prefix_length(n: int, similarity: float) -> int:
    """How many of a set's first shingles hold one of every set that is similar enough."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    rank = np.argsort(common)
    known = common[rank]
    for texts in _each_once(batches):
        keys, sets, sizes, places = [], [], [], []
        for text in texts:
            own = shingle_array(text, width)
            if not len(own):
                continue
            name = set_name(own)
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                own = own[np.argsort(np.where(known[at] == own, rank[at] + 1, 0), kind="stable")]
            head = own[: prefix_length(len(own), similarity)]
            keys.append(head)
            sets.append(np.full(len(head), name, np.int64))
            sizes.append(np.full(len(head), len(own), np.int64))
            places.append(np.arange(len(head), dtype=np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (sets, sizes, places))], ["key", "set", "n", "place"])


def _verified(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    known: tuple[int | None, set[int]] = (None, set())
    for batch in slices(slices(batches, "text"), "other_text"):
        keep = []
        for other, text, other_text in zip(*(column(batch, c).to_pylist() for c in ("b", "text", "other_text")), strict=True):
            if known[0] != other:
                known = other, shingle_set(other_text, width)
            mine = shingle_set(text, width)
            both = len(mine & known[1])
            keep.append(both >= similarity * (len(mine) + len(known[1]) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Rows of ids and tags up to which such a table is broadcast, some 20 MB; a larger one meets the texts in a shuffle.
BROADCAST_ROWS = 500_000


def _sized(df: DataFrame) -> DataFrame:
    """A settled table of ids and tags, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar_pairs(pairs: DataFrame, most: int | None, sets: DataFrame, rows: DataFrame, width: int, similarity: float, paths: list[str]) -> DataFrame:
    """Those of the pairs (a, b) of sets, of which there are at most so many if that is known, whose exact Jaccard similarity is high enough.

    Sketches differ in at most as many bits as sets in shingles, so they spare most texts the way without losing a pair.
    """
    small = sets.select("set", "n", "sketch")
    near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    if most is None:
        near = settle_table(near, paths)
        most = near.count()
    near = near.join(small.toDF("a", "n", "sketch"), "a").join(small.toDF("b", "b_n", "b_sketch"), "b")
    apart = F.aggregate(F.zip_with("sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.col("n") + F.col("b_n")
    near = settle_table(gather(near.where((F.least("n", "b_n") >= similarity * F.greatest("n", "b_n") - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * both + 1e-6)).select("a", "b"), most), paths)
    needed = near.select("a").union(near.select("b")).distinct().toDF("set").join(sets.select("set", F.col("doc_id").alias("its_id"), F.col("tag").alias("its_tag")), "set")
    most = near.count()
    needed = _sized(settle_table(gather(needed, 2 * most), paths))
    found = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("tag") == F.col("its_tag")))
    texts = settle_table(gather(found.select("set", "text").dropDuplicates(["set"]), 2 * most, 2_000), paths)
    compared = near.join(texts.toDF("a", "text"), "a").join(texts.toDF("b", "other_text"), "b").select("a", "b", "text", "other_text")
    return settle_table(gather(compared, most, 2_000).mapInArrow(lambda it: _verified(it, width, similarity), "a long, b long"), paths)


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, n, keep): distinct rows by id and text, how often each occurs, and whether it stays for its group.

    Groups are the components of all pairs of texts whose sets of word shingles have at least that Jaccard similarity;
    every link is verified, and no pair is missed. Two similar sets have a shingle in common among the first
    ``prefix_length`` of each, in any one order of all shingles; the common ones come last. A first round compares the sets
    within ``radius`` bits of each other by their SimHash, and for every such shingle each set with one other: where the
    fewest rarer shingles precede it, which is the text of a group that the others are edits of. A second one compares
    all that share a shingle and aren't in one group yet. One row of each group stays: the least id (null ids last),
    then the least tag. Null and wordless texts are one group. A very long text is held whole, with its shingles. Ties and
    repeated rows are rows of one group; other columns are ignored; an empty table gives no rows.

    Texts stay where they are, but for those of candidate pairs; profiles and prefixes, which move, hold hashes only.
    """
    paths: list[str] = []
    rows = keyed_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    profile = settle_table(rows.mapInArrow(lambda it: _profiles(it, width), PROFILE), paths)
    n_rows = profile.count()
    sets = settle_table(gather(profile.dropDuplicates(["set"]), n_rows), paths)
    heads = settle(gather(sets.groupBy("fp").agg(F.min("set").alias("head")), n_rows))
    links = link_values(heads.select("fp"), radius)
    alike = sets.select("set", "fp").join(heads, "fp").select(F.col("set").alias("a"), F.col("head").alias("b"))
    alike = alike.union(links.join(heads.toDF("a", "head_a"), "a").join(heads.toDF("b", "head_b"), "b").select("head_a", "head_b"))
    common = common_shingles(rows, width)
    prefixes = rows.select("tag", "text").mapInArrow(lambda it: _prefixes(it, width, similarity, common), PREFIX)
    by_key = Window.partitionBy("key")
    shared = prefixes.withColumns({"least": F.min(F.struct("place", "set", "n")).over(by_key), "low": F.min("set").over(by_key), "most": F.max("set").over(by_key)}).where("low <> most")
    shared = settle_table(shared.select("key", "set", "n", "place", "least").dropDuplicates(["key", "set"]), paths)
    fits = lambda n, place, m, at: F.least(n - place, m - at) >= similarity / (1 + similarity) * (n + m) - 1e-6
    star = shared.where(fits(F.col("n"), F.col("place"), F.col("least.n"), F.col("least.place"))).select("set", "least.set")
    n_shared = shared.count()
    close = similar_pairs(alike.union(star), n_shared + 2 * n_rows, sets, rows, width, similarity, paths)
    known = settle_table(gather(components(close), 2 * n_rows), paths).withColumnsRenamed({"node": "set", "root": "whole"})
    grouped = shared.drop("least").join(known, "set", "left").withColumn("whole", F.coalesce("whole", "set"))
    grouped = grouped.withColumns({"least": F.min("whole").over(by_key), "most": F.max("whole").over(by_key)}).where("least <> most")
    grouped = settle_table(gather(grouped.select("key", "set", "n", "place", "whole"), n_shared), paths)
    a, b = grouped.alias("a"), grouped.alias("b")
    further = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.set") < F.col("b.set")) & (F.col("a.whole") != F.col("b.whole")) & fits(*(F.col(c) for c in ("a.n", "a.place", "b.n", "b.place"))))
    further = similar_pairs(further.select(F.col("a.set").alias("a"), F.col("b.set").alias("b")), None, sets, rows, width, similarity, paths)
    joined = components(close.union(further))
    small = profile.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.first("set").alias("set"))
    groups = small.join(joined.select(F.col("node").alias("set"), F.col("root").alias("whole")), "set", "left").withColumn("whole", F.coalesce("whole", "set"))
    groups = settle_table(gather(groups.select("doc_id", "tag", "n", "whole"), n_rows), paths)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    stays = groups.groupBy("whole").agg(F.min(rank).alias("stay"))
    kept = groups.join(stays, "whole").select("doc_id", "tag", "n", (F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("tag") == F.col("stay.tag"))).alias("keep"))
    out = settle_table(gather(kept, n_rows))
    clear_tables(docs.sparkSession, paths)
    return out


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The table without near-duplicates: of each group of ``similar_groups`` one row stays, whole and unchanged.

    Of repeated rows that stay one is kept, whichever comes first. Nulls, empty and very long texts and an empty table are
    as in ``similar_groups``. All columns are kept; names that begin with __near are an error.
    """
    if any(c.startswith("__near") for c in docs.columns):
        raise ValueError("columns named __near... are the operator's own")
    groups = similar_groups(docs, width, similarity, radius)
    key = lambda df: df.select(F.col("doc_id").alias("__near_id"), F.col("tag").alias("__near_tag"))
    gone, repeated = key(groups.where("not keep or n > 1")), key(groups.where("keep and n > 1"))
    rows = docs.withColumns({"__near_own_id": F.col("doc_id").cast("long"), "__near_own_tag": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    same = F.col("__near_own_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_own_tag") == F.col("__near_tag"))
    once, more = rows.join(_sized(gone), same, "left_anti"), rows.join(_sized(repeated), same, "left_semi")
    return once.unionByName(more.dropDuplicates(["__near_own_id", "__near_own_tag"])).select(*docs.columns)
