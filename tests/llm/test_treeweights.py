import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import treeweights as tw
from tests.llm.samples import frame, rows


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 10, 1234.5, 1e7])
    assert np.allclose(tw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (tw.undeltas(tw.deltas(keys)) == keys).all()
        assert (tw.unsqueeze(tw.squeeze(keys.astype(np.float32)), np.float32) == keys.astype(np.float32)).all()


def plain_bytes(text):
    return b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())) + b"\n"


class PlainTree:
    """Context-tree weighting straight from the definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            b = b"\n" * depth + t
            for i in range(depth, len(b)):
                for bit in range(8):
                    u = (1 << bit) | (b[i] >> (8 - bit))
                    for d in range(depth + 1):
                        ctx = b[i - d : i][::-1]
                        self.counts[u, ctx][b[i] >> (7 - bit) & 1] += 1
                        if d:
                            self.children[u, ctx[:-1]].add(ctx)
        self.memo = {}

    def own(self, u, ctx):
        a, b = self.counts.get((u, ctx), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, u, ctx):
        if (u, ctx) not in self.memo:
            if len(ctx) == self.depth:
                v = self.own(u, ctx)
            else:
                v = np.logaddexp(self.own(u, ctx), sum(self.weighted(u, c) for c in self.children.get((u, ctx), ()))) - math.log(2)
            self.memo[u, ctx] = v
        return self.memo[u, ctx]

    def bit(self, u, ctx, full, bit):
        a = self.counts.get((u, ctx), (0, 0))
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if len(ctx) == self.depth:
            return own
        stop = math.exp(self.own(u, ctx) - math.log(2) - self.weighted(u, ctx))
        return stop * own + (1 - stop) * self.bit(u, full[: len(ctx) + 1], full, bit)

    def score(self, t):
        b = b"\n" * self.depth + t
        total = 0.0
        for i in range(self.depth, len(b)):
            full = b[i - self.depth : i][::-1]
            for k in range(8):
                total += math.log10(self.bit((1 << k) | (b[i] >> (8 - k)), b"", full, b[i] >> (7 - k) & 1))
        return total


@pytest.mark.parametrize(("block_bytes", "at_once", "piece_keys"), [(16 << 20, 64, 1 << 18), (300, 2, 5)])
def test_scores_match_the_definition(spark, monkeypatch, block_bytes, at_once, piece_keys):
    for name, value in (("MERGED_NODES", at_once), ("PIECE_KEYS", piece_keys), ("BUCKET_BYTES", 10 if at_once == 2 else 8 << 20)):
        monkeypatch.setattr(tw, name, value)
    data = [r if r[1] is None or len(r[1]) < 5000 else (r[0], r[1][:200], *r[2:]) for r in rows(n=25)]
    got = tw.score_documents(frame(spark, data), block_bytes).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for d, t, *_ in data}
    train = [(words[d], plain_bytes(t)) for d, t, *_ in data if not held(d)]
    c = Counter(w for ws, _ in train for w in ws)
    n, v = sum(c.values()), len(c)
    tree = PlainTree([b for _, b in train], tw.DEPTH)
    want = {d: tree.score(plain_bytes(t)) for d, t, *_ in data}
    assert len(got) == len(data)
    for r in got:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
        assert abs(r.score - want[r.doc_id]) < 1e-4 * max(1, abs(want[r.doc_id]))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    strings = np.unique(rng.integers(0, 2**32, 50, dtype=np.uint64))
    contexts = np.unique(strings >> np.uint64(8))[:3]
    every = (contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)[None]).ravel()
    keys, counts = tw.summed(np.concatenate([strings, every]), np.concatenate([rng.integers(1, 9, len(strings)), np.zeros(len(every), np.int64)]))
    flat, below = tw.piece_sums(keys, counts)
    ones, stop, weighted = (x[0] for x in tw.weigh_nodes(flat[None], below[None]))
    crown = tw.Crown([(101, flat.tobytes(), weighted.tobytes())])
    p = 10 ** tw.log10_probabilities(keys, counts, 101, (ones, stop), crown)
    for c in contexts:
        assert abs(p[keys >> np.uint64(8) == c].sum() - 1) < 1e-9


def test_empty_table(spark):
    assert tw.score_documents(frame(spark, [])).count() == 0


def test_many_empty_texts_in_one_block(spark):
    docs = spark.range(70_000).selectExpr("id as doc_id", "cast('' as string) as text").union(spark.createDataFrame([(70_000, "one two")], "doc_id long, text string")).coalesce(1)
    got = tw.score_documents(docs).groupBy("n_tokens").count().collect()
    assert {r.n_tokens: r["count"] for r in got} == {1: 70_000, 3: 1}


def test_a_table_that_reads_differently_the_second_time_is_an_error(spark):
    docs = frame(spark, [(i, f"some text {i}", None, None, 0, None, None) for i in range(20)]).coalesce(1)
    block = tw._score_block
    part = tw.Slice(["some text"])
    keys, words = tw.summed(part.keys)[0], np.unique(part.words)
    assert tw.block_digest(keys, words) != tw.block_digest(keys[::-1].copy(), words)
    told = tw.pa.table({"block": [0], "space": tw.pa.array([tw.DIGEST], tw.pa.int32()), "bucket": [1], "answers": tw.pa.nulls(1, tw.pa.binary())})
    with pytest.raises(RuntimeError, match="differ between passes"):
        block(tw.pa.table({"block": [0], "doc_id": [1], "text": ["some text"]}), told, 1, 1, 1)
    assert tw.score_documents(docs).count() == 20
