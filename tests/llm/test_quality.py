import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.common import utf8
from tests.llm.samples import frame, rows


def by_enumeration(emission, switch):
    weights = {}
    for states in itertools.product((0, 1), repeat=len(emission)):
        w = sum(e for e, s in zip(emission, states, strict=True) if s) + sum(switch[a, b] for a, b in itertools.pairwise(states))
        weights[states] = math.exp(w)
    z = sum(weights.values())
    good = [sum(w for s, w in weights.items() if s[i]) / z for i in range(len(emission))]
    moves = np.zeros((2, 2))
    for s, w in weights.items():
        for a, b in itertools.pairwise(s):
            moves[a, b] += w / z
    return good, moves, math.log(z)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    lengths = [3, 1, 0, 6, 2, 0, 6]
    first = np.cumsum([0, *lengths])
    emission, switch = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    good, moves, total = quality.marginals(emission, switch, first)
    want = [by_enumeration(emission[a:b], switch) for a, b in itertools.pairwise(first) if b > a]
    assert np.allclose(good, [g for w in want for g in w[0]]) and np.allclose(moves, sum(w[1] for w in want)) and math.isclose(total, sum(w[2] for w in want), rel_tol=1e-9)


def shapes(texts):
    import pyarrow as pa

    return quality.line_shapes(*utf8(pa.array(texts, pa.string())))


def test_lines_and_their_shapes():
    lines = shapes(["", "ab c\n\n  \nXYZ!!", "\n", "one"])
    assert lines.first.tolist() == [0, 0, 2, 2, 3] and lines.length.tolist() == [5, 5, 3]
    assert lines.features[0, 0] == pytest.approx(3 / 5) and lines.features[1, 1] == pytest.approx(3 / 5) and lines.features[1, 7] == pytest.approx(2 / 5)
    near = quality.with_neighbours(lines)
    n = quality.FEATURES
    assert (near[0, 2 * n : 3 * n] == lines.features[1]).all() and (near[1, n : 2 * n] == lines.features[0]).all() and not near[2, n : 3 * n].any()


def test_shapes_do_not_depend_on_company():
    texts = [t or "" for _, t, *_ in rows()]
    together = shapes(texts)
    for i, t in enumerate(texts):
        alone = shapes([t])
        a, b = together.first[i : i + 2]
        assert np.allclose(together.features[a:b], alone.features) and (together.length[a:b] == alone.length).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels)
    assert got.count() == docs.count()
    test = got.where("held_out").join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) for d in test.doc_id)
    assert len(test) > 80 and (test.predicted == test.quality).mean() >= 0.95
    assert ((test.score >= 0.5) == test.predicted.astype(bool)).all() and test.score.between(0, 1).all()


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(frame(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    scores = {}
    for (d, t, *_), in zip(rows()):
        scores.setdefault(t or "", set()).update(r.score for r in got if r.doc_id == d)
    assert all(max(s) - min(s) < 1e-9 for s in scores.values())
    assert quality.score_documents(frame(spark, []), labels).count() == 0
    none = quality.score_documents(frame(spark), labels.where("false")).collect()
    assert {r.predicted for r in none} == {1} and len(none) == len(rows())
    with pytest.raises(ValueError):
        quality.with_quality(frame(spark), quality.train(frame(spark), labels), "text")
    kept = quality.with_quality(frame(spark), quality.train(frame(spark), labels), "q")
    assert kept.columns == [*frame(spark).columns, "q"] and kept.where(F.col("text").isNull()).count() >= 1


def test_mixed_documents_teach_their_lines(spark):
    """Labels are of documents, but half the lines of a bad document are like those of good ones."""
    rng = np.random.default_rng(2)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)).capitalize() + "."
    bad = lambda: "|".join("#$%{}=_"[rng.integers(7)] * 3 for _ in range(20))
    texts, labels = [], []
    for i in range(120):
        labels.append(i % 2)
        texts.append("\n".join(good() if labels[-1] or j < 6 else bad() for j in range(12)))
    lines = shapes(texts)
    truth = np.array([not t.startswith(("#", "$", "%", "{", "}", "=", "_")) for x in texts for t in x.split("\n")])
    right = []
    for refinements in (0, 4):
        model = quality.fit(lines, np.array(labels), refinements=refinements)
        p, _, _ = quality.marginals(quality.with_neighbours(lines) @ model.weights, model.switch, lines.first)
        right.append(((p >= 0.5) == truth).mean())
        assert ((model.scores(lines) >= 0.5) == np.array(labels).astype(bool)).mean() > 0.95
    assert right[1] >= right[0]


def test_scores_match_enumeration(spark):
    """A document's score from all ways to label its lines, written out."""
    rng = np.random.default_rng(5)
    texts = ["One line here.\nAnother line!\n||| {} ||", "x", "A b c.\n\n a b\nlast one", "", None]
    lines = shapes([t or "" for t in texts])
    near = quality.with_neighbours(lines)
    model = quality.Model(rng.normal(size=near.shape[1]), rng.normal(size=(2, 2)), 3.0, -1.0, 0.25)
    want = []
    for a, b in itertools.pairwise(lines.first):
        if a == b:
            want.append(0.25)
            continue
        good, _, _ = by_enumeration((near[a:b] @ model.weights).tolist(), model.switch)
        share = np.dot(good, lines.length[a:b]) / lines.length[a:b].sum()
        want.append(1 / (1 + math.exp(-(3.0 * share - 1.0))))
    got = quality.with_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), model, "q").collect()
    assert np.allclose([r.q for r in sorted(got, key=lambda r: r.i)], want)
