import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import phrases
from tests.llm.samples import frame, rows


def names(text: bytes, level: int):
    symbols, starts = np.frombuffer(text, np.uint8), np.array([0])
    for k in range(1, level + 1):
        symbols, starts = phrases.parse_level(symbols, starts, k)
    return symbols


@pytest.mark.parametrize("seed", range(8))
def test_equal_substrings_share_interior_phrases(seed):
    rng = random.Random(seed)
    common = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    a, b = (bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(1, 90))) + common + b"tail" * rng.randrange(3) for _ in range(2))
    for level, lost in ((1, 20), (2, 40), (3, 60)):
        x, y = names(a, level), names(b, level)
        shared = len(set(x.tolist()) & set(y.tolist()))
        assert shared >= len(set(names(common, level).tolist())) - lost
        assert 1 < len(common) ** (1 / level) and len(x) < len(a) / 2**level


def test_texts_are_parsed_as_if_alone():
    texts = [(t or "").encode() for _, t, *_ in rows()] + [b"\0\0", b"\0", b"aaaa", b"aaaaa", b"ab" * 500]
    together = phrases.sketches(texts)
    for t, row in zip(texts, together, strict=True):
        assert (phrases.sketches([t])[0] == row).all()
    assert len({r.tobytes() for r in together}) == len(set(texts))


def test_periodic_texts_stay_bounded():
    for unit in (b"a", b"ab", b"abc", b"\0\x01"):
        assert len(names(unit * 20_000, 3)) < 20_000


def test_likeness_follows_overlap():
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    a, b, c = make(400), make(400), make(400)
    f = [r.tobytes().hex() for r in phrases.sketches([x.encode() for x in (a, a[: len(a) // 2] + b[: len(b) // 2], c, a)])]
    assert phrases.text_likeness(f[0], f[3]) == 1 and 0.2 < phrases.text_likeness(f[0], f[1]) < 0.5 and phrases.text_likeness(f[0], f[2]) < 0.1
    assert phrases.text_likeness(f[0], "00" * 128) == 0 and phrases.text_likeness("00" * 128, "00" * 128) == 1


@pytest.mark.parametrize("ranges", [1, 2, 5, 200])
def test_edited_neighbours(spark, ranges):
    data = rows()
    got = phrases.edited_neighbours(frame(spark), ranges).collect()
    order = sorted(((d, t or "") for d, t, *_ in data), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        s = phrases.sketches([x.encode() for x in (t, edited, nxt)])
        near = [float(phrases.likeness(s[0], s[j])) for j in (1, 2)]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), s[0].tobytes().hex(), s[1].tobytes().hex(), *near))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_small_tables(spark):
    assert phrases.edited_neighbours(frame(spark, [])).count() == 0 == phrases.fingerprint_documents(frame(spark, [])).count()
    one = phrases.edited_neighbours(frame(spark, [(None, "abcd", *[None] * 5)])).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(None, 1.0, hashlib.sha256(b"abab").hexdigest())]
    assert phrases.fingerprint_documents(frame(spark)).count() == len(rows())
