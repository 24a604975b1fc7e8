import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.index import ColumnNotFound, build
from lodestone.plans import search, store

GOLDEN = [(0, "Under My Skin"), (1, "I've Got You Under My Skin, under my skin"), (2, "Strangers in the Night"), (3, ""), (4, "Skin deep: naïve skin SKIN")]


@pytest.fixture(scope="module")
def golden(spark):
    return build(spark.createDataFrame(GOLDEN, "id long, text string"), ["text"], "id").persist()


def ask(index, text, k=10, **options):
    return [(r.doc_id, r.score) for r in search.search_ids(index, {"text": text}, k, **options).collect()]


EXPECTED = [
    ("under my skin", {}, [(0, 7.412704), (1, 6.466553), (4, 2.752730)]),
    ("under my skin", {"mode": "and"}, [(0, 7.412704), (1, 6.466553)]),
    ("skin", {}, [(4, 2.752730), (0, 2.017861), (1, 1.760303)]),
    ("skin", {"how": "tfidf"}, [(4, 5.210897), (1, 3.473931), (0, 1.736966)]),
    ("skin", {"how": "auto"}, [(4, 5.210897), (1, 3.473931), (0, 1.736966)]),
    ("skin skin", {}, [(4, 5.505460), (0, 4.035722), (1, 3.520606)]),
    ("skin skin", {"how": "auto"}, [(4, 5.505460), (0, 4.035722), (1, 3.520606)]),
    ("night skin", {}, [(2, 3.459523), (4, 2.752730), (0, 2.017861), (1, 1.760303)]),
    ("night skin", {"mode": "and"}, []),
    ("zebra skin", {}, [(4, 2.752730), (0, 2.017861), (1, 1.760303)]),
    ("zebra skin", {"mode": "and"}, []),
    ("zebra", {}, []),
    ("", {}, []),
    ("!!!", {"mode": "and"}, []),
    ("skin", {"boosts": {"TEXT": 2.0}}, [(4, 5.505460), (0, 4.035722), (1, 3.520606)]),
]


@pytest.mark.parametrize(("text", "options", "want"), EXPECTED)
def test_golden_scores(golden, text, options, want):
    got = ask(golden, text, **options)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def test_extras(golden):
    base = dict(ask(golden, "my skin"))
    boosted = dict(ask(golden, "my skin", phrases=True))
    assert boosted[0] == pytest.approx(base[0] * 1.4, abs=1e-5) and boosted[1] == pytest.approx(base[1] * 1.4**2, abs=1e-5) and boosted[4] == base[4]
    first = dict(ask(golden, "skin under", first_place=True))
    plain = dict(ask(golden, "skin under"))
    assert first[4] == pytest.approx(plain[4] + 25, abs=1e-5) and first[0] == pytest.approx(plain[0] + 25, abs=1e-5) and first[1] == plain[1]


def test_limits_and_errors(golden):
    for k in (0, 1001):
        with pytest.raises(ValueError):
            ask(golden, "skin", k)
    assert len(ask(golden, "skin", 1)) == 1
    with pytest.raises(ColumnNotFound):
        search.search_ids(golden, {"nope": "x"})
    with pytest.raises(search.ColumnNotSearchable):
        search.search_ids(golden, {"id": "x"})
    with pytest.raises(ColumnNotFound):
        build(golden.documents, ["nope"], "id")


def corpus(spark, seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(30)]
    line = lambda m: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(m)))
    return [(i, line(20), line(8)) for i in range(n)]


def brute(data, texts, boosts, mode="or"):
    total = {}
    need = {(f, t) for f, q in texts.items() for t in q.split()}
    have = {}
    for f, q in texts.items():
        col = {"A": 1, "B": 2}[f]
        docs = {r[0]: r[col].split() for r in data}
        avg = sum(map(len, docs.values())) / len(docs)
        for t in q.split():
            df = sum(t in d for d in docs.values())
            for i, d in docs.items():
                if tf := d.count(t):
                    have.setdefault(i, set()).add((f, t))
                    idf = 1 + math.log2(len(docs) / df)
                    total[i] = total.get(i, 0) + boosts.get(f, 1) * idf * 2.4 * tf / (tf + 1.4 * (0.25 + 0.75 * len(d) / avg))
    keep = [i for i in total if mode == "or" or have[i] == need]
    return sorted(((i, total[i]) for i in keep), key=lambda x: (-round(x[1], 6), x[0]))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    data = corpus(spark, seed)
    frame = spark.createDataFrame(data, "id long, a string, b string")
    texts, boosts = {"A": "W1 W2 W3 W1", "B": "W4 W2"}, {"a": 2.0}
    small = {"A": "W1 W2", "B": "W4"}
    for df in (frame.coalesce(1), frame.repartition(7)):
        index = build(df, ["b", "a"], "id")
        for q, mode in ((texts, "or"), (small, "and")):
            got = [(r.doc_id, r.score) for r in search.search_ids(index, q, 1000, boosts, mode=mode).collect()]
            want = brute(data, q, {"A": 2.0}, mode)
            assert [d for d, _ in got] == [d for d, _ in want]
            assert all(abs(x - y) < 1e-5 for (_, x), (_, y) in zip(got, want, strict=True))


def test_properties(spark):
    index = build(spark.createDataFrame(corpus(spark, 9), "id long, a string, b string"), ["a", "b"], "id").persist()
    score = lambda q, **o: dict((r.doc_id, r.score) for r in search.search_ids(index, q, 1000, **o).collect())
    a, b, both = score({"a": "w1 w2"}), score({"b": "w3"}), score({"a": "w1 w2", "b": "w3"})
    assert all(both[d] == pytest.approx(a.get(d, 0) + b.get(d, 0), abs=1e-5) for d in both) and set(both) == set(a) | set(b)
    assert set(score({"a": "w1 w2"}, mode="and")) <= set(a)
    assert all(x == pytest.approx(3 * a[d], abs=1e-5) for d, x in score({"a": "w1 w2"}, boosts={"A": 3.0}).items())


def test_saved_index_answers_alike_and_prunes(spark, tmp_path, golden):
    store.save(golden, str(tmp_path / "i"), "golden")
    again = store.load(spark, str(tmp_path / "i"))
    assert ask(again, "under my skin") == ask(golden, "under my skin")
    plan = search.matching(again, search.parse(again, {"text": "skin night"}))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(term, [NIGHT,SKIN])" in plan
    store.save(golden, str(tmp_path / "i"), "golden")
    assert store.load(spark, str(tmp_path / "i")).postings.count() == golden.postings.count()
    assert store.default_path("a") != store.default_path("b")


def test_plan_has_no_needless_shuffle(golden, spark, tmp_path):
    store.save(golden, str(tmp_path / "p"))
    plan = search.search_ids(store.load(spark, str(tmp_path / "p")), {"text": "under my skin"})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Exchange hashpartitioning(doc_id") == 1 and "SortMergeJoin" not in plan


def test_batch_matches_single_queries(golden, spark):
    asked = spark.createDataFrame([(1, "text", "under my skin"), (2, "TEXT", "night skin"), (3, "text", "zebra")], "query_id int, field string, text string")
    got = {}
    for r in search.batch(golden, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {1: ask(golden, "under my skin", 3), 2: ask(golden, "night skin", 3)}


@pytest.mark.parametrize("seed", range(3))
def test_batch_matches_single_queries_where_terms_are_pruned(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "GUESS", 1)
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    line = lambda m: " ".join(rng.choices([f"w{i}" for i in range(60)], weights, k=m))
    index = build(spark.createDataFrame([(i, line(rng.randrange(1, 30))) for i in range(300)], "id long, text string"), ["text"], "id").persist()
    texts = [line(rng.randrange(1, 12)) for _ in range(12)]
    got = {}
    asked = spark.createDataFrame([*((i, "text", t) for i, t in enumerate(texts))], "query_id int, field string, text string")
    for r in search.batch(index, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, t in enumerate(texts):
        want = ask(index, t, 3)
        assert [d for d, _ in got[i]] == [d for d, _ in want] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got[i], want, strict=True))


@pytest.mark.parametrize("chunk", [1, 40, 1 << 21])
def test_batch_ranks_within_chunks_and_shuffles_no_single_postings(spark, monkeypatch, tmp_path, chunk):
    """Packed postings go to their chunk's group; saved indexes and those of several fields are dealt out by id; equal texts go by id."""
    monkeypatch.setattr(search, "CHUNK", chunk)
    rng = random.Random(chunk)
    line = lambda m: " ".join(f"w{int(rng.expovariate(0.3))}" for _ in range(m))
    data = [(i, "w1 w2 w1" if i % 3 == 0 else line(rng.randrange(0, 20)), line(rng.randrange(3))) for i in range(120)]
    one = build(spark.createDataFrame(data, "id long, t string, u string"), ["t"], "id").settle()
    store.save(one, str(tmp_path / "one"))
    two = build(one.documents, ["t", "u"], "id").settle()
    texts = {"a": "w1", "b": "w2 w1 w7 w2", "c": "w0 w3 w5 w8 zebra", "d": "zebra", "e": ""}
    for index, fields in ((one, ["t"]), (store.load(spark, str(tmp_path / "one")), ["t"]), (two, ["t", "u"])):
        asked = spark.createDataFrame([*((q, f, t) for q, t in texts.items() for f in fields), (None, "t", "w1")], "query_id string, field string, text string")
        run = search.batch(index, asked, 5)
        if index is one:
            plan = run._jdf.queryExecution().executedPlan().toString()
            assert "Generate" not in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
        got = {}
        for r in run.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.rank, r.score))
        for q in texts:
            want = [(r.doc_id, i + 1, r.score) for i, r in enumerate(search.search_ids(index, dict.fromkeys(fields, texts[q]), 5).collect())]
            assert [x[:2] for x in got.pop(q, [])] == [x[:2] for x in want]
        assert not got


def test_batch_cuts_queries_into_blocks(spark, golden, monkeypatch):
    asked = spark.createDataFrame([(i, "text", "under my skin") for i in range(20)], "query_id int, field string, text string")
    monkeypatch.setattr(search, "PAIRS", 7)
    monkeypatch.setattr(search, "BROADCAST_PAIRS", 0)
    want = ask(golden, "under my skin", 2)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search.batch(golden, asked, 2).collect())
    assert got == [(i, n + 1, d, s) for i in range(20) for n, (d, s) in enumerate(want)]


def scanned(df, name="numOutputRows"):
    """The rows that the plan's file scans gave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply(name).value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_fetch_reads_few_row_groups(spark, tmp_path):
    """Saved documents lie in order of id in small row groups; the ids of the results skip those without them."""
    data = spark.range(40_000).selectExpr("39999 - id as id", "concat('common ', sha2(cast(id as string), 256), if(id % 9000 = 5, ' rare', '')) as text")
    store.save(build(data, ["text"], "id"), str(tmp_path / "big"), row_group_bytes=1 << 16)
    index = store.load(spark, str(tmp_path / "big"))
    rows = search.search(index, {"text": "rare"}, 5)
    assert "In(id, [" in rows._jdf.queryExecution().toString() and "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in rows.collect()) == sorted(39999 - i for i in range(5, 40_000, 9000))
    assert scanned(rows) < 20_000
    many = search.search(index, {"text": "common"}, 50)
    assert len(many.collect()) == 50 and [r.SCORE for r in many.collect()] == sorted((r.SCORE for r in many.collect()), reverse=True)


def test_phrases_need_one_pass(golden, spark):
    plan = search.search_ids(golden, {"text": "under my skin"}, phrases=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Window" not in plan and "SortMergeJoin" not in plan


def test_fetch_drops_a_source_column_named_score(spark):
    index = build(spark.createDataFrame([(1, "x y", 5), (2, "x", 6)], "id long, t string, score int"), ["t"], "id")
    rows = search.search(index, {"t": "x"})
    assert rows.columns == ["id", "t", "SCORE"] and [r.id for r in rows.collect()] == [2, 1]


def test_empty_table(spark):
    index = build(spark.createDataFrame([], "id long, t string"), ["t"], "id")
    assert search.search(index, {"t": "x"}).count() == 0 and index.terms.count() == 0
    nulls = build(spark.createDataFrame([(1, None), (None, "x")], "id long, t string"), ["t"], "id")
    assert nulls.stats.select(F.col("n_docs")).first()[0] == 2
