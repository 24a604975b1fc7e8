import re
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import mixing
from tests.llm.samples import frame, rows


def slow_targets(sizes, weights):
    """Share, cap, reshare the excess, again until none is above."""
    t = [1.5 * sum(sizes) * w / sum(weights) for w in weights]
    while any(x > 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True)):
        excess = sum(max(0, x - 2 * s) for x, s in zip(t, sizes, strict=True))
        t = [min(x, 2 * s) for x, s in zip(t, sizes, strict=True)]
        open_ = sum(w for x, s, w in zip(t, sizes, weights, strict=True) if x < 2 * s - 1e-12)
        if not open_:
            break
        t = [x + excess * w / open_ if x < 2 * s - 1e-12 else x for x, s, w in zip(t, sizes, weights, strict=True)]
    return t


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, [10, 1000][seed % 2], rng.integers(1, 12)).tolist()
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert np.allclose(mixing.fill_targets(sizes, weights), slow_targets(sizes, weights), rtol=1e-6, atol=1e-6)


def test_quotas_split_exactly():
    q = np.array([0, 7, 1000, 33, 9 * 10**8], np.int64)
    for shards in (1, 2, 7, 16):
        got = mixing.split_quotas(q, shards, 3)
        assert got.shape == (shards, 5) and (got >= 0).all() and (got.sum(axis=0) == q).all()
        assert np.ptp(got.sum(axis=1)) <= shards
        assert (got == mixing.split_quotas(q, shards, 3)).all()
    with pytest.raises(ValueError, match="at most"):
        mixing.split_quotas(np.array([10**9], np.int64), 2, 3)


def test_table(spark):
    documents, draws = mixing.mix_sources(frame(spark), shards=4)
    got = documents.collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows()}
    assert len(got) == len(rows()) and all(r["size"] == size[r.doc_id] for r in got)
    by = defaultdict(int)
    for _, t, _, s, *_ in rows():
        by[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, slow_targets([by[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    drawn = defaultdict(int)
    for r in draws.collect():
        assert 0 <= r.shard < 4
        drawn[r.source] += r.words
    assert {s: n for s, n in drawn.items() if n} == {s: n for s, n in taken.items() if n}
    again = mixing.mix_sources(frame(spark).repartition(5), shards=4)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(frame(spark, []))[0].count() == 0


def test_written_shards(spark, tmp_path):
    documents, draws = mixing.mix_sources(frame(spark), shards=3)
    mixing.write_mix(draws, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).groupBy().sum("words").first()[0] == documents.groupBy().sum("taken").first()[0]


def test_taken_is_what_the_quotas_deal(spark, monkeypatch):
    documents, draws = mixing.mix_sources(frame(spark), shards=4)
    total = documents.groupBy().sum("taken").first()[0]
    last = draws.where("shard = 3").groupBy().sum("words").first()[0]
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: split(quotas, shards, seed) * (1 if shards < 4 else np.array([[1], [1], [1], [0]])))
    fewer = mixing.mix_sources(frame(spark), shards=4)[0].groupBy().sum("taken").first()[0]
    assert last > 0 and fewer == total - last


def test_mix_is_laid_out_by_shard_and_order(spark):
    data = [(i, f"text{i} a b c", "en", f"s{i % 3}", 1, "x", 1) for i in range(900)]
    drawn = mixing.mix_sources(frame(spark, data), shards=2)[1].orderBy("shard", "order_key", "doc_id").collect()
    parts = mixing.take_mix(frame(spark, data), shards=2).select("doc_id").rdd.glom().collect()
    assert len({r.shard for r in drawn}) == 2 and len(parts) == 4
    assert [r.doc_id for p in parts for r in p] == [r.doc_id for r in drawn]


def test_rows_that_are_alike_are_drawn_as_rows_of_their_own(spark):
    """One text holds most of a source, so its rows straddle the end of the last pass; others share its id or text only."""
    data = [(7, "one two three four five", "en", "a", 23, f"{i}", i) for i in range(50)]
    data += [(7, "one two three four five", "en", "b", 23, "x", 0), (8, "one two three four five", "en", "a", 23, "x", 0), (None, "one two three four five", "en", None, 23, "x", 0)]
    data += [(i, f"other {i} words here", "en", "b", 9, "x", 1) for i in range(100, 130)]
    documents, draws = mixing.mix_sources(frame(spark, data), shards=3)
    taken = {(r.source, r.doc_id): r.n for r in documents.groupBy("source", "doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    got = mixing.take_mix(frame(spark, data), shards=3).collect()
    out = defaultdict(int)
    for r in got:
        out[r.source, r.doc_id] += len((r.text or "").split())
    assert out == {k: n for k, n in taken.items() if n}
    each = defaultdict(int)
    for r in got:
        each[r.doc_id, r.source, r.fingerprint, r.n] += len(r.text.split())
    assert max(each.values()) <= 10 and not any(c.startswith("__") for c in got[0].asDict())
    with pytest.raises(ValueError, match="operator's own"):
        mixing.take_mix(frame(spark, data).withColumnRenamed("n", "__mix_x"))
