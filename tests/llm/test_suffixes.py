import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffixes
from tests.llm.samples import frame, rows


def naive(texts, width):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen.setdefault(t[i : i + width], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + width] = True
    out = []
    for t, g in zip(texts, gone, strict=True):
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((len(t), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randrange(90, 500)) for _ in range(6)]
    out = ["ab" * 300, "ab" * 299 + "c", "z" * 450, "z" * 199, make(199), make(200)]
    for _ in range(40):
        t = make(rng.randrange(400))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[: a if rng.random() < 0.3 else None] + make(rng.randrange(60))
        out.append(t)
    near = out[-1] * 2
    return [*out, near, near[:300] + "!" + near[300:], out[-2], out[-2], out[-3] + "x"]


@pytest.mark.parametrize(("seed", "bucket_rows", "most"), [(1, 150_000, 2000), (2, 40, 2000), (3, 7, 3), (4, 1, 0)])
def test_removes_what_brute_force_removes(spark, monkeypatch, seed, bucket_rows, most):
    monkeypatch.setattr(suffixes, "MOST_STRETCHES", most)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(suffixes, "SAMPLE", 2)
    texts = corpus(seed)
    data = [(i if i % 10 else i, t, None, None, 0, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.remove_repeats(frame(spark, data)).collect()}
    want = naive([t.encode() for t in texts], 200)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def test_awkward_rows(spark):
    data = [*rows(), (7000, "q" * 100 + "r" * 150, None, None, 1, None, None), (None, "q" * 100 + "r" * 150, None, None, 1, None, None), (8000, None, None, None, None, None, None)]
    got = sorted((str(r.doc_id), *r[1:]) for r in suffixes.remove_repeats(frame(spark, data)).collect())
    want = [(str(d), *w) for (d, *_), w in zip(data, naive([(t or "").encode() for _, t, *_ in data], 200), strict=True)]
    assert got == sorted(want)
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_equal_windows_have_equal_points():
    rng = np.random.default_rng(3)
    common = rng.integers(97, 101, 900, dtype=np.uint8)
    a, b = np.concatenate([rng.integers(97, 101, 333, dtype=np.uint8), common]), np.concatenate([common, rng.integers(97, 101, 50, dtype=np.uint8)])
    raw, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    p = suffixes.sample_points(raw, offsets)
    assert p["count"].sum() == len(a) + len(b) - 2 * 199
    assert len(p["count"]) < 2.6 * len(raw) / (suffixes.WIDTH - suffixes.NAME + 1)
    firsts = [set(p["name"][p["doc"] == d].tolist()) for d in (0, 1)]
    assert len(firsts[0] & firsts[1]) >= 5
    where = offsets[p["doc"]] + p["start"] + p["left"]
    tokens = sorted(zip(*(p[k].tolist() for k in suffixes.KEYS[: suffixes.LEAD]), (raw[w : w + 32].tobytes() for w in where), strict=True))
    assert [t[-1] for t in tokens] == sorted(t[-1] for t in tokens)  # tokens order suffixes as their bytes do


def test_multikey_order():
    rng = np.random.default_rng(4)
    tokens = [rng.integers(-2, 3, 700) for _ in range(4)]
    order = suffixes.multikey_order(tokens)
    assert [*zip(*(t[order].tolist() for t in tokens), strict=True)] == sorted(zip(*(t.tolist() for t in tokens), strict=True))


def test_buckets_follow_the_order_and_equal_suffixes_are_spread():
    rng = np.random.default_rng(5)
    keys = [rng.integers(-1, 2, 900) for _ in suffixes.KEYS]
    order = suffixes.multikey_order(keys)
    splitters = np.column_stack(keys)[order][100::100]
    splitters[3] = splitters[4] = splitters[5]
    bucket = suffixes.place_in_buckets(keys, splitters)
    rows = np.column_stack(keys).tolist()
    for row, b in zip(rows, bucket.tolist(), strict=True):
        assert (b == 0 or splitters[b - 1].tolist() <= row) and (b == len(splitters) or row <= splitters[b].tolist())
    drawn = splitters.tolist()
    for cut in drawn:
        equal = {b for r, b in zip(rows, bucket.tolist(), strict=True) if r == cut}
        assert len(equal) == 1 if drawn.count(cut) == 1 else equal <= set(range(drawn.index(cut), drawn.index(cut) + drawn.count(cut) + 1))


def test_buckets_know_what_goes_on_beyond_their_boundaries():
    """Of three buckets, the suffixes of the middle one that are equal to a splitter drawn twice, or begin like a splitter."""
    low, twice, high = [0] * 5 + [1], [1] * 6, [2] * 6
    splitters = np.array([low, twice, twice, high])
    rows = np.array([[1] * 5 + [0], twice, [1, 1, 1, 1, 0, 9]])
    table = {k: rows[:, i] for i, k in enumerate(suffixes.KEYS)} | {c: np.arange(3) for c in ("doc_id", "tag", "start", "count", "left")} | {"bucket": np.full(3, 1)}
    for most in (5, 6):  # two splitters begin so, for buckets of one row or two
        got = suffixes.compare_bucket(table, splitters, most, 1)
        assert sorted(zip(got["doc_id"].tolist(), got["whole"].tolist(), got["partly"].tolist(), got["hot"].tolist(), strict=True)) == [(0, False, True, most < 6), (1, True, True, most < 6)]


def test_windows_are_compared_by_their_bytes():
    """Names that agree for different bytes don't matter: a stretch's windows are compared byte by byte."""
    rng = random.Random(6)
    common = bytes(rng.randrange(97, 99) for _ in range(400))
    texts = [common[i : i + 200 + n] for i, n in ((0, 20), (5, 15), (0, 5))] + [bytes(rng.randrange(97, 99) for _ in range(210))]
    offsets = np.cumsum([0, *map(len, texts)])
    left = np.array([60, 55, 60, 40])
    got = suffixes.shared_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, left, np.zeros(4, np.int64), 200)
    windows = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
    assert got.tolist() == [windows.count(w) > 1 for w in windows]


@pytest.mark.parametrize("piece", [300, 1000])
def test_long_texts_are_sampled_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    texts = [*corpus(9)[-8:], "".join(corpus(9))]
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.remove_repeats(frame(spark, [(i, t, None, None, 0, None, None) for i, t in enumerate(texts)]).repartition(len(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == naive([t.encode() for t in texts], 200)
