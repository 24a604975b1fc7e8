import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing
from tests.llm.samples import frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.WordIds(PATH, limit=50)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n.,'!?%$sStTéÉßİΣς0９<|>\x1ćÅ "), st.characters(codec="utf-8")), max_size=40))
def test_words_give_the_ids_of_texts(text):
    e = test_words_give_the_ids_of_texts.__dict__.setdefault("e", packing.WordIds(PATH, limit=50))
    assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == whole(e.tokenizer, text)


def test_ids_of_documents(encoder, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["don't <|endoftext|>x can't's", "'start O'REILLY's"]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(encoder.tokenizer, text)


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, h = packing.combinations(), rng.integers(0, 500, 32).astype(float)
        x = packing.nonnegative_least_squares(a, h)
        gain = a.T @ (h - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-5 and np.abs(gain[x > 0]).max() < 1e-5


def held(pieces, lengths, window=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(by_doc[d]):
            assert s == at and k > 0
            at += k
        assert at == n
    for parts in by_seq.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [5, 300, 5000, 4096, 20_000, 129][seed], [3, 500, 400, 200, 60, 2000][seed]).tolist()
    held(packing.pack(lengths), lengths)


def test_pack_edges():
    for lengths in ([], [1], [4096], [4096] * 3, [4097], [2048] * 7, [0, 3]):
        held(packing.pack(lengths), lengths)


def test_table(spark):
    df = frame(spark)
    got = packing.pack_documents(df, PATH, block_tokens=2000).collect()
    encoder = packing.WordIds(PATH)
    want = sorted(((d, [*np.frombuffer(encoder.ids([t or ""])[0], "<u4").tolist(), 2]) for d, t, *_ in rows()), key=str)
    ids, seqs = defaultdict(list), defaultdict(int)
    for r in sorted(got, key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        ids[r.doc_id] += r.ids
        seqs[r.sequence_id] += r.length
    assert sum(map(len, ids.values())) == sum(len(x) for _, x in want)
    for d, x in want[:-2]:
        if sum(k == d for k, _ in want) == 1:
            assert ids[d] == x
    assert all(n == 4096 or n & (n - 1) == 0 for n in seqs.values())
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
