import hashlib
import zlib

import numpy as np
import pytest

from lodestone.llm import media
from tests.llm.samples import frame, rows


def test_rows_read_back(spark):
    got = media.media_columns(frame(spark)).collect()
    assert len(got) == len(rows())
    want = {}
    for d, t, *_ in rows():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[d] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.decode_png(bytes(r.media)).tobytes()[: r.n_bytes] == next((t or "").encode() for d, t, *_ in rows() if d == r.doc_id)
    assert media.media_columns(frame(spark, [])).count() == 0


def test_checksums_are_tested():
    png = media.encode_png(bytes(range(64)) * 3)
    for at in (3, 20, len(png) // 2, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


@pytest.mark.parametrize("seed", range(4))
def test_all_filters_are_undone(seed):
    rng = np.random.default_rng(seed)
    rows_, kinds = rng.integers(0, 256, (40, 64)), rng.integers(0, 5, 40)
    lines = np.zeros((40, 65), np.uint8)
    for r in range(40):
        for i in range(64):
            a = rows_[r, i - 1] if i else 0
            b = rows_[r - 1, i] if r else 0
            c = rows_[r - 1, i - 1] if r and i else 0
            p = a + b - c
            d = [abs(p - x) for x in (a, b, c)]
            guess = [0, a, b, (a + b) // 2, (a, b, c)[d.index(min(d))]][kinds[r]]
            lines[r, i + 1] = (rows_[r, i] - guess) % 256
        lines[r, 0] = kinds[r]
    assert (media.unfilter(lines) == rows_).all()


def test_hash_follows_the_picture():
    rng = np.random.default_rng(1)
    a = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 8))).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 8))).astype(np.uint8)
    bits = lambda x, y: (int(media.cosine_hash(x), 16) ^ int(media.cosine_hash(y), 16)).bit_count()
    assert bits(a, b) <= 6 < 16 <= bits(a, other)


@pytest.mark.parametrize("lines", [1, 5, 32, 45, 700])
def test_hash_is_the_cosine_transform_of_the_shrunk_picture(lines):
    """Against sums written out: area averages on a 32 x 32 grid, then the 8 x 8 lowest coefficients against their median."""
    rng = np.random.default_rng(lines)
    picture = rng.integers(0, 256, (lines, 64)).astype(np.uint8)
    fine = np.repeat(picture.astype(float), 32, axis=0)  # each line is 32 strips, each grid row as many strips as there are lines
    grid = fine.reshape(32, lines, 32, 2).mean(axis=(1, 3))
    low = np.array([[sum(grid[y, x] * np.cos(np.pi * (2 * y + 1) * v / 64) * np.cos(np.pi * (2 * x + 1) * u / 64) for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)])
    low = np.round(low, 6)
    want = low.ravel() > np.median(low.ravel()[1:])
    got = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(picture)), np.uint8)).astype(bool)
    assert (got != want).sum() == 0


def test_large_images_are_filtered_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    for payload in (rng.integers(0, 256, 64 * 50, dtype=np.uint8), np.cumsum(rng.integers(0, 3, 64 * 50), dtype=np.uint8), np.tile(rng.integers(0, 256, 64, dtype=np.uint8), 50)):
        whole = media.encode_png(payload.tobytes())
        monkeypatch.setattr(media, "LINES", 7)
        assert media.decode_png(media.encode_png(payload.tobytes())).tobytes() == payload.tobytes() == media.decode_png(whole).tobytes()
        monkeypatch.undo()


def test_a_broken_image_is_an_error(spark):
    png = bytearray(media.encode_png(bytes(64)))
    png[-20] ^= 1
    table = spark.createDataFrame([(1, 64, png)], media.MEDIA)
    with pytest.raises(Exception, match="checksum|truncated|not a PNG"):
        media.describe_media(table).collect()
