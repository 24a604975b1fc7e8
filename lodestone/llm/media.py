"""Media columns: lossless PNG payloads with checksum-tested chunks, numpy unfiltering and low-frequency cosine hashes.

``encode_media`` makes a binary column of images, ``describe_media`` reads such a column, wherever it comes from.
``media_columns`` stores the first as a table in the shared folder and describes what that table holds. There is no
shuffle: memory is bounded by one Arrow slice, or one text, and a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import column, keyed_text, settle_table, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of the image, and so the unit to which payloads are padded.
WIDTH = 64
IDAT_BYTES = 1 << 16
#: Lines of an image that are filtered at a time.
LINES = 1 << 14
GRID = 32
LOW = 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _residuals(rows: np.ndarray, kind: int, a: int, b: int) -> np.ndarray:
    """Lines a to b under filter 0 (none), 1 (left) or 2 (up)."""
    part = rows[a:b]
    if kind == 0:
        return part
    out = part.copy()
    if kind == 1:
        out[:, 1:] -= part[:, :-1]
    else:
        out[a == 0 :] -= rows[max(a - 1, 0) : b - 1]
    return out


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit greyscale PNG, 64 samples wide. One filter is chosen per image: none, left or up, whichever has the smallest residuals."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    blocks = [(a, min(a + LINES, len(rows))) for a in range(0, len(rows), LINES)]
    cost = lambda k: sum(int(np.abs(_residuals(rows, k, a, b).view(np.int8).astype(np.int16)).sum(dtype=np.int64)) for a, b in blocks)
    kind = min(range(3), key=cost)
    packer, body = zlib.compressobj(level), []
    for a, b in blocks:
        lines = np.empty((b - a, WIDTH + 1), np.uint8)
        lines[:, 0] = kind
        lines[:, 1:] = _residuals(rows, kind, a, b)
        body.append(packer.compress(lines.tobytes()))
    packed = b"".join([*body, packer.flush()])
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def read_chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of every chunk; ValueError where the signature, a length or a checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r} fails")
        yield kind, body
        at += 12 + n


def _paeth(a: int, b: int, c: int) -> int:
    """The predictor of the PNG specification."""
    p = a + b - c
    return min((a, b, c), key=lambda x: abs(p - x))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five PNG filters for one byte per sample. Runs of lines with the same simple filter are undone at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    starts = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(lines)]
    at = 0
    for to in starts:
        kind = int(kinds[at]) if to > at else 0
        if kind == 1:
            out[at:to] = np.cumsum(out[at:to], axis=1, dtype=np.uint8)
        elif kind == 2:
            above = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
            out[at:to] = np.cumsum(out[at:to], axis=0, dtype=np.uint8) + above
        elif kind:
            for r in range(at, to):
                above = out[r - 1].tolist() if r else [0] * out.shape[1]
                line, a, c = out[r].tolist(), 0, 0
                for i, x in enumerate(line):
                    b = above[i]
                    a = line[i] = (x + ((a + b) // 2 if kind == 3 else _paeth(a, b, c))) & 255
                    c = b
                out[r] = line
        at = to
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, after every checksum has been tested."""
    head, body, ended = None, [], False
    for kind, data in read_chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended |= kind == b"IEND"
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(head[1], head[0] + 1))


_k, _i = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
COSINES = np.cos(np.pi * (2 * _i + 1) * _k / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """Sixteen hex digits: which of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32, exceed their median."""
    rows, cols = samples.shape
    edges = np.arange(GRID + 1) * rows / GRID
    whole = np.minimum(edges.astype(np.int64), rows)
    part = edges - whole
    marks, place = np.unique(whole, return_inverse=True)
    bands = np.add.reduceat(samples, marks[:-1], axis=0, dtype=np.float64)
    at = np.vstack([np.zeros(cols), np.cumsum(bands, axis=0)])[place] + part[:, None] * samples[np.minimum(whole, rows - 1)]
    grid = np.diff(at, axis=0).reshape(GRID, GRID, cols // GRID).mean(axis=2) * (GRID / rows)
    low = COSINES @ grid @ COSINES.T
    flat = np.round(low.ravel(), 6)  # what cancels out is zero, and not the order of its sums
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


MEDIA = "doc_id long, n_bytes long, media binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text").cast(pa.binary()).to_pylist()
        media = [encode_png(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in texts]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a PNG."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_encoded, MEDIA)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), *(["media"] if keep_media else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches, "media"):
        out = []
        for png in column(batch, "media").to_pylist():
            samples = decode_png(png)
            back = samples.tobytes()
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
        found = (pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *found, *([column(batch, "media")] if keep_media else [])], names)


def describe_media(media: DataFrame, keep_media: bool = True) -> DataFrame:
    """What the images of a table (doc_id, n_bytes, media) hold, after every checksum has been tested; a broken image is an error."""
    return media.mapInArrow(lambda it: _described(it, keep_media), SCHEMA + (", media binary" if keep_media else ""))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text's UTF-8 bytes as a PNG in a binary column, read the column back and describe it; ``keep_media`` returns it too.

    Null and empty texts are a payload of 64 zero bytes. A very long text is one image, held about three times at once.
    Null ids, repeated rows and ties are kept as they come, one row out for each row in; other columns are ignored; an
    empty table gives an empty result.
    """
    return describe_media(settle_table(encode_media(docs, id_col, text_col)), keep_media)
