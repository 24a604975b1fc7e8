import random
import re

import corpus_pipeline
from lodestone.llm import secrets, simhash
from lodestone.llm.common import settle_table
from lodestone.llm.mixing import take_mix
from tests.llm.samples import frame, rows, words


def similarity(a, b, width=5):
    x, y = (simhash.shingle_set(t or "", width) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def with_copies(seed):
    """Originals, exact copies, and copies in which about one word in a hundred is replaced; the originals come last."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(120, 300), 5000) for _ in range(25)]
    out = []
    for t in base[:12]:
        for _ in range(rng.randrange(1, 6)):
            w = t.split()
            for k in rng.sample(range(len(w)), max(1, len(w) // 100)):
                w[k] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out += base[12:16] * 2 + base
    return [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(out)]


def test_near_duplicates_against_brute_force(spark):
    data = with_copies(1)
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, data)).collect()}
    texts = {d: t for d, t, *_ in data}
    pairs = [(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8]
    both = [p for p in pairs if set(p) <= kept]
    assert len(pairs) > 20 and len(both) <= len(pairs) // 50
    for d in set(texts) - kept:
        assert any(d in p for p in pairs)
    assert len(kept) >= 25 - 1


def test_each_group_keeps_one_whole_row(spark):
    got = simhash.keep_one(frame(spark)).collect()
    data = rows()
    known = {(d, t) for d, t, *_ in data}
    assert all((r.doc_id, r.text) in known for r in got) and len({(r.doc_id, r.text) for r in got}) == len(got)
    empties = [r for r in got if not (r.text or "").split()]
    assert len(empties) == 1 and empties[0].doc_id == 0
    assert sum(r.text == "same words here again" for r in got) == 1
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_mix_is_taken(spark):
    df = frame(spark)
    got = take_mix(df, shards=3).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(t) for _, t, *_ in rows())
    taken = sum(size(r.text) for r in got)
    assert abs(taken - 1.5 * total) <= 5 and take_mix(df).columns == df.columns
    texts = {t for _, t, *_ in rows()}
    cut = [r.text for r in got if r.text not in texts]
    assert len(cut) <= 6 and all(any(" ".join((t or "").split()).startswith(c) for t in texts) for c in cut)
    assert take_mix(frame(spark, [])).count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle_table(stage(spark, docs, sf))
        after[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.collect()} for n, d in after.items()}
    good = {d for d, q in labels.items() if q == 1}
    assert len(good - ids["quality"]) <= len(good) // 20 and len({d for d, q in labels.items() if q == 0} & ids["quality"]) <= 2
    kept = {d: before[d].text for d in ids["near_duplicates"]}
    near = [(a, b) for a in kept for b in kept if a < b and similarity(kept[a], kept[b]) >= 0.8]
    assert ids["near_duplicates"] <= ids["quality"] and len(near) <= 1
    assert ids["secrets"] == ids["near_duplicates"] and not any(secrets.secret_spans(r.text)[0] for r in after["secrets"].collect())
    assert ids["mixing"] <= ids["secrets"] and ids["packing"] == ids["mixing"]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(map(tuple, after["packing"].drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))


def grouped(spark, texts):
    """What brute force keeps, and what ``keep_one`` keeps."""
    data = [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)]
    root = list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a, texts[j]) >= 0.8:
                x, y = sorted((up(i), up(j)))
                root[y] = x
    return {up(i) for i in range(len(texts))}, {r.doc_id for r in simhash.keep_one(frame(spark, data)).collect()}


def test_no_pair_is_missed_among_hubs_and_short_texts(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(8):
        template = words(rng, 150, 5000)
        texts += [f"{template} {words(rng, 12, 5000)}", f"{template} {words(rng, 12, 5000)}"]
        texts.append(f"{template} {' '.join(words(rng, 150, 5000) for _ in range(4))}")
    for _ in range(30):
        short = words(rng, 12, 5000)
        texts += [short, f"{short} more"]
        copy = words(rng, 60, 5000).split()
        edited = [*copy[:30], "edited", *copy[31:]]
        texts += [" ".join(copy), " ".join(edited)]
    want, got = grouped(spark, texts)
    assert got == want and len(want) < len(texts) - 60


def test_equal_fingerprints_are_verified(spark):
    rng = random.Random(12)
    line = " ".join(f"word{i}" for i in range(11))
    texts = [f"{' '.join([line] * 1000)} {words(rng, 200, 5000)}" for _ in range(3)]
    assert len({simhash.fingerprint(t, 5) for t in texts}) == 1
    texts.append(f"{texts[2]} more")
    want, got = grouped(spark, texts)
    assert got == want == {0, 1, 2}
