import json
import math
import random
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestone.api import SearchIndex, details, json_rows, search_first, serve
from lodestone.functions import rendering, sets
from lodestone.operators import evaluate, suggest
from lodestone.operators.index import block_maxima, build
from lodestone.operators.progress import watched

#: The dictionary of the prefix tests, in insertion order (key, value, score).
WORDS = [
    ("ostritch", 24, 3), ("test", 420, 2), ("testing", 69, 2), ("tes", 24, 2), ("waddup", 54, 4), ("newting", 44, 5), ("tosting", 69, 2), ("toaster", 84, 2), ("magisterialness", 64, 6),
    ("rapper", 85, 8), ("apple", 25, 2), ("apocryphol", 25, 2), ("apacryphol", 25, 2), ("apicryphol", 25, 2), ("eager", 25, 2), ("mantequilla", 25, 2), ("initial", 25, 2), ("initial", 32, 2), ("abracadabra", 121, 7),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    rows = [(k, v, s, i) for i, (k, v, s) in enumerate(WORDS)]
    return spark.createDataFrame(rows, "key string, value int, score int, ord int")


def test_dictionary(dictionary):
    last = suggest.upsert_scored(dictionary)
    value = lambda k: [r.value for r in suggest.find(last, k).collect()]
    for k, v in {"test": 420, "testing": 69, "tes": 24, "waddup": 54, "abracadabra": 121, "initial": 32, "eager": 25, "magisterialness": 64}.items():
        assert value(k) == [v]
    assert value("testin") == []
    assert [r.key for r in suggest.prefix_keys(last, "tes", 10).collect()] == ["tes", "test", "testing"]
    assert [r.key for r in suggest.prefix_keys(last, "testin", 10).collect()] == ["testing"]
    assert [r.key for r in suggest.prefix_top(last, "a", 3).collect()] == ["abracadabra", "apacryphol", "apicryphol"]
    assert {r.key: r.value for r in suggest.insert_absent(dictionary).collect()}["initial"] == 25


def test_character_frequencies(spark):
    got = {r.character: r.weight for r in suggest.character_frequencies(spark.createDataFrame([("aab",), ("ba",), ("",)], "w string"), "w").collect()}
    assert got == {"a": 3 + 2 + 1, "b": 1 + 2}


def test_highlighting():
    assert rendering.mark("Under my <Skin>", ["skin"]) == 'Under my &lt;<span class="highlight">Skin</span>&gt;'
    assert rendering.mark("abcabc", ["abc"]) == '<span class="highlight">abcabc</span>'
    assert rendering.mark("aaa x", ["aa"]) == '<span class="highlight">aaa</span> x'
    assert rendering.mark("a-b c", ["ab"]) == '<span class="highlight">a-b</span> c'
    assert rendering.mark("<&>", []) == "&lt;&amp;&gt;" and rendering.mark(None, ["a"]) is None


def test_highlight_columns(spark):
    df = spark.createDataFrame([("the Theme",), (None,)], "t string")
    assert [r[0] for r in df.select(rendering.highlight(F.col("t"), "THE!")).collect()][0].count("highlight") == 2
    assert spark.createDataFrame([("salt & pepper",)], "t string").select(rendering.highlight(F.col("t"), "amp")).first()[0] == "salt &amp; pepper"
    assert spark.createDataFrame([("<a>",)], "t string").select(rendering.highlight(F.col("t"), "!?")).first()[0] == "&lt;a&gt;"


def test_query_strings(spark):
    got = spark.createDataFrame([("title=under+my+skin&Artist=a%20%26%20b&x=&bad",)], "q string").select(rendering.decode_query(F.col("q"))).first()[0]
    assert got == {"TITLE": "under my skin", "ARTIST": "a & b", "X": ""}


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 99, 1), (2, 21, 1), (3, 30, 0)], "query_id int, doc_id int, grade int")
    got = {r.query_id: r for r in evaluate.judged(run, rel, 3).collect()}
    dcg, ideal = 1 / math.log2(3) + 2 / math.log2(4), 2 + 1 / math.log2(3) + 1 / math.log2(4)
    assert set(got) == {1, 2} and got[1].precision == pytest.approx(2 / 3) and got[1].recall == pytest.approx(2 / 3)
    assert got[1].average_precision == pytest.approx((1 / 2 + 2 / 3) / 3) and got[1].ndcg == pytest.approx(dcg / ideal) and got[2].ndcg == 0
    assert evaluate.metrics(run, rel, 3).first().n_queries == 2


def test_nearest_ranks(spark):
    df = spark.range(250).select((F.col("id") % 50).alias("v"))
    want = sorted(i % 50 for i in range(250))
    assert {r.p: r.value for r in evaluate.nearest_ranks(df, "v").collect()} == {p: want[p * 2] for p in range(100)}
    assert evaluate.nearest_ranks(df.limit(20), "v").count() == 0


def test_nearest_ranks_of_any_spread(spark):
    rng = random.Random(4)
    values = [rng.choice([0, 1, 5, 10**6, rng.randrange(10**5)]) for _ in range(5000)]
    got = evaluate.nearest_ranks(spark.createDataFrame([(v,) for v in [*values, None]], "v long").repartition(5), "v", 100)
    assert {r.p: r.value for r in got.collect()} == {p: sorted(values)[p * 50] for p in range(100)}


def test_containing_is_plain_containment(spark):
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice(["ab", "cd", "e", " ", ", ", "Ab", "é"]) for _ in range(n))
    texts = [line(60) for _ in range(40)] + ["", "x" * 700 + " tail end here"]
    index = build(spark.createDataFrame([*enumerate(texts), (99, None)], "id long, t string"), ["t"], "id").persist()
    asked = [t[a : a + n] for t in texts[:20] for a, n in ((3, 25), (10, 4), (0, 40))] + ["zz yy xx", "x" * 300 + " tail end", "", None, "ab"]
    got = evaluate.containing(index, "T", spark.createDataFrame([*enumerate(asked)], "query_id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for q, p in enumerate(asked) if p is not None for d, t in enumerate(texts) if p in t)


def test_containing_shuffles_no_texts(spark, monkeypatch):
    """Texts are searched where they are read; more passages than a task may hold are joined, with the same rows."""
    texts = [None, "", *(f"é {i % 7} common b{i % 5} ñandú {i % 3}, end" for i in range(60)), "x common b1 ñandú 1"]
    index = build(spark.createDataFrame([*enumerate(texts)], "id long, t string"), ["t"], "id").persist()
    asked = ["common b1 ñandú 1", "COMMON b1 ñandú", "é 3 common b", "common b2 ñandú 2, e", "2 common zebra b1", "common b1 ñandú 1"]
    passages = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "query_id string, text string")
    want = sorted((str(q), i) for q, a in enumerate(asked) for i, t in enumerate(texts) if t and a in t)
    monkeypatch.setattr("lodestone.operators.evaluate.HELD_PASSAGES", 5, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = evaluate.containing(index, "t", passages)
        assert "Exchange hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == want
        monkeypatch.setattr("lodestone.operators.evaluate.HELD_PASSAGES", 0)
        assert sorted(tuple(r) for r in evaluate.containing(index, "t", passages).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")



def test_progress(spark):
    with watched(spark) as progress:
        assert progress.fraction() == 0.0
        spark.range(1000).repartition(3).count()
    done, all_ = progress.tasks()
    assert done == all_ >= 3 and progress.fraction() == 1.0
    spark.range(10).repartition(2).count()
    assert progress.tasks() == (done, all_)


def test_sets(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 3, "b"), (2, None, None)], "k int, v int, w string")
    assert {r.k: (r.v, r.w) for r in sets.sorted_arrays(df, "k", "v", "w").collect()} == {1: ([1, 3, 3], ["a", "b", "c"]), 2: ([None], [None])}
    assert {r.k: r.v for r in sets.sorted_arrays(df, "k", "v", descending=True).collect()}[1] == [3, 3, 1]
    assert {r.k: r.n for r in sets.distinct_members(df, "k", "v").collect()} == {1: 2, 2: 1}
    assert {r.v: r.first for r in sets.first_occurrences(df, "v", "k").collect()} == {1: 1, 3: 1, None: 2}
    bits = df.select(sets.bit_is_set(F.col("v"), 1), sets.with_bit(F.col("v"), 2), sets.without_bit(F.col("v"), 0)).collect()
    assert [tuple(r) for r in bits] == [(True, 7, 2), (False, 5, 0), (True, 7, 2), (None, None, None)]


def test_block_maxima(spark):
    index = build(spark.createDataFrame([(i, "x " * (i % 7 + 1)) for i in range(130)], "id long, t string"), ["t"], "id")
    for span in (1 << 16, 10, 1):
        got = sorted((r.block, r.max_tf, r.max_doc_id) for r in block_maxima(index.postings, span=span).collect())
        assert got == [(0, 7, 63), (1, 7, 127), (2, 4, 129)]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("Under My Skin", "Frank Sinatra", 3), ("Night & Day", None, 4), ("Skin", "Nobody", 5)]
    return SearchIndex.from_dataframe(spark, spark.createDataFrame(rows, "title string, artist string, length int"), ["title", "ARTIST"]).persist()


def test_facade(index, spark, tmp_path):
    assert index.columns() == ["DOC_ID", "TITLE", "ARTIST", "LENGTH"] and index.search_columns() == ["TITLE", "ARTIST"]
    ids, scores = index.query_arrays({"title": "skin"}, k=5)
    assert len(ids) == 2 and (scores[:-1] >= scores[1:]).all() and index.query_arrays({"title": "zebra"})[0].size == 0
    best = index.query_dicts({"title": "under skin", "artist": "frank"}, {"TITLE": 2.0}, 1)[0]
    assert best["TITLE"] == "Under My Skin" and best["LENGTH"] == "3" and len(best["SCORE"].split(".")[1]) == 4
    assert index.query_dicts({"title": "day"})[0]["ARTIST"] == ""
    path = index.save(str(tmp_path / "saved"))
    assert SearchIndex.load(spark, path).query_dicts({"title": "skin"}) == index.query_dicts({"title": "skin"})
    assert [r.key for r in index.suggest("title", "n").collect()] == ["NIGHT"]
    with pytest.raises(ValueError):
        SearchIndex(spark).query({"a": "b"})


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('title,artist\n"Under My Skin","Frank, S."\nSkin,\n')
    index = SearchIndex.from_file(spark, str(tmp_path / "x.csv"), ["Title"])
    assert [(d["DOC_ID"], d["ARTIST"]) for d in index.query_dicts({"TITLE": "my skin"})] == [("0", "Frank, S."), ("1", "")]
    (tmp_path / "x.json").write_text('{"title": "Under My Skin", "n": 4}\n{"title": "Night", "n": null}\n')
    index = SearchIndex.from_file(spark, str(tmp_path / "x.json"), ["title", "n"])
    assert [d["TITLE"] for d in index.query_dicts({"n": "4"})] == ["Under My Skin"]


def test_result_views(index):
    rows = index.query({"title": "under"})
    assert search_first(index.index, rows).columns[:2] == ["TITLE", "ARTIST"]
    assert [r.key for r in details(rows).collect()] == sorted([*index.columns(), "SCORE"])
    assert json.loads(json_rows(rows).first()[0])["TITLE"] == "Under My Skin"


def test_service(index):
    server = serve(index, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read()
    try:
        assert get("/healthcheck") == b"" and json.loads(get("/get_columns"))["columns"][-1] == "SCORE"
        assert json.loads(get("/get_search_columns"))["columns"] == ["TITLE", "ARTIST"]
        found = json.loads(get("/search?TITLE=under+my%20skin&SCORE=9"))
        assert [r["TITLE"] for r in found["results"]] == ["Under My Skin", "Skin"] and found["time_taken_us"] > 0
    finally:
        server.shutdown()
        server.server_close()
