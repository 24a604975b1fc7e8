import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.analysis import tokens
from lodestone.operators import index as built
from lodestone.operators.index import build, split_terms
from lodestone.plans import search

ODD = ["", None, "a", "  a--B c\x7f ", "é É naïve_x", "x" * 253, "y" * 254, "Ü" * 255, "z" * 700 + " q", "日本 語a\tb", "ab", "cd", "'", "0 9", "\x00a\x00"]


def test_terms_are_those_of_the_column_expression(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aZ09 -_é日\x7f@[`{~") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = [r.w for r in df.orderBy("i").select(tokens("t", most=None).alias("w")).collect()]
    for column in (pa.array(texts), pa.array(["cut", *texts]).slice(1), pa.array(texts, pa.large_string())):
        terms, size = split_terms(column)
        ends = np.cumsum(size)
        assert [terms.slice(e - n, n).to_pylist() for e, n in zip(ends.tolist(), size.tolist(), strict=True)] == want


def rows(texts):
    return pa.RecordBatch.from_pydict({"field": pa.array(["T"] * len(texts), pa.string()), "doc_id": pa.array(range(len(texts), 0, -1), pa.int64()), "text": pa.array(texts, pa.string())})


@pytest.mark.parametrize("chunk", [1, 7, 1 << 21])
def test_chunks_hold_every_posting_once(monkeypatch, chunk):
    """However large a batch is, what is grouped at a time stays bounded, and chunks are in order of term and id."""
    monkeypatch.setattr(built, "CHUNK", chunk)
    monkeypatch.setattr(built, "SLICE", 8)
    texts = ["b a b", "", "c a", "a", "b b b b b b b b b"]
    out = [b for x in (rows(texts), rows([]), rows(["", ""])) for b in built._packed(iter([x]))]
    got = sorted((t, d, tf, n, p) for b in out for r in b.to_pylist() for t, (d, tf, n, p) in ((r["term"], x) for x in zip(r["doc_ids"], r["tfs"], r["dls"], r["positions"], strict=True)))
    assert got == [("A", 2, 1, 1, [0]), ("A", 3, 1, 2, [1]), ("A", 5, 1, 3, [1]), ("B", 1, 9, 9, list(range(9))), ("B", 5, 2, 3, [0, 2]), ("C", 3, 1, 2, [0])]
    assert len(out) == (1 if chunk > 7 else 3 if chunk == 1 else 2)
    for b in out:
        assert b["term"].to_pylist() == sorted(b["term"].to_pylist()) and all(x == sorted(x) for x in b["doc_ids"].to_pylist())
        assert b["df"].to_pylist() == [len(x) for x in b["doc_ids"].to_pylist()] and b["cf"].to_pylist() == [sum(x) for x in b["tfs"].to_pylist()]


def test_a_kept_index_reads_only_the_files_of_its_terms(spark):
    index = build(spark.createDataFrame([(1, "a b a"), (2, "b c")], "id long, t string"), ["t"], "id").persist()
    plan = index.hits().where("field = 'T' and term = 'A'")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "positions" not in plan.split("Physical Plan")[1]
    assert "EqualTo(term,A)" in plan
    assert spark.catalog.clearCache() is None  # postings are kept nevertheless
    assert "MapInArrow" not in search.scores(index, search.parse(index, {"t": "a"}))._jdf.queryExecution().toString()
    assert [(r.doc_id, r.tf, r.dl, r.positions) for r in index.postings.where(F.col("term") == "A").collect()] == [(1, 2, 3, [0, 2])]


def test_a_query_reads_only_the_row_groups_of_its_terms(spark, monkeypatch):
    """What a task reads is counted: of a chunk in many row groups, those that hold the query's terms."""
    monkeypatch.setattr(built, "ROW_GROUP_BYTES", 1 << 14)
    many = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(20_000)))))
    index = build(spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("the cat "), many).alias("t")), ["t"], "id").persist()
    sc = spark.sparkContext

    def read(name, rows):
        sc.setJobGroup(name, name)
        got = rows.count()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
        done = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in stages]
        return got, sum(s.inputRecords() for s in done)

    terms = index.packed.count()
    query = search.parse(index, {"t": "the cat"})
    found, some = read("some", search.matching(index, query, positions=False))
    postings, every = read("every", index.hits())
    assert found == 4000 and postings > 190_000
    assert every == terms > 19_000
    assert 2 <= some < terms / 4
