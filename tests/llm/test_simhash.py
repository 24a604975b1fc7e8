import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from tests.llm.samples import frame, rows


def plain(text, width=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, radius):
    root = {v: v for v in values}

    def up(v):
        while root[v] != v:
            v = root[v]
        return v

    vs = sorted(root)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {v: up(v) for v in vs}


def test_fingerprints_and_components(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    fps = [(d, plain(t)) for d, t, *_ in rows()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{f:016x}") for d, f in fps)
    root = classes({f for _, f in fps}, 2)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    for r in got:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def noisy(rng, n, centres):
    out = set()
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        out.add(v - 2**64 if v >= 2**63 else v)
    return sorted(out)


@pytest.mark.parametrize(("radius", "segments", "max_bucket"), [(2, 8, 512), (2, 8, 5), (1, 4, 512), (1, 4, 5), (2, 16, 2)])
def test_links_connect_all_close_values(spark, radius, segments, max_bucket):
    rng = random.Random(radius * 100 + segments + max_bucket)
    values = noisy(rng, 300, [rng.getrandbits(64) for _ in range(9)])
    links = [tuple(r) for r in simhash.link_values(spark.createDataFrame([(v,) for v in values], "fp long"), radius, segments, max_bucket).collect()]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()} if links else {}
    want = classes(values, radius)
    assert all(want[a] == want[b] for a, b in links) and len(links) < 8 * 65 * len(values)
    groups = lambda f: sorted(sorted(v for v in values if f(v) == r) for r in {f(v) for v in values})
    assert groups(lambda v: found.get(v, v)) == groups(lambda v: want[v])


def test_long_chains_settle(spark):
    pairs = [(i + 1, i) for i in range(300)] + [(1000, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_filter_keeps_all_true_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    values = np.unique(base ^ (np.uint64(1) << rng.integers(0, 30, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 200, dtype=np.uint64)))
    i, j = simhash.pigeonring_pairs(values, 0, 2, 8)
    assert (np.bitwise_count(values[i] ^ values[j]) <= 2).all()


def test_segments_widen_with_the_number_of_values():
    assert simhash.segments_for(10) == simhash.segments_for(2**31) == 8 and simhash.segments_for(2**32) == 16 and simhash.segments_for(2**40) == 32
    for n in (10, 2**32, 2**35):
        m = simhash.segments_for(n)
        assert n >> simhash.chain_key_length(2, m) * 64 // m <= simhash.MAX_BUCKET // 4
