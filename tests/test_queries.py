"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from lodestone.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == want and got


def test_entry_stands_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for n in ("lodestone", "__spark_entry__.py"):
        os.symlink(f"{root}/{n}", tmp_path / n) if n != "lodestone" else os.mkdir(tmp_path / n)
    for n in os.listdir(f"{root}/lodestone"):
        if n not in ("llm", "__pycache__"):
            os.symlink(f"{root}/lodestone/{n}", tmp_path / "lodestone" / n)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_bm25_or_top10' in q and not any(k.startswith('op') for k in q); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) == len(ORACLES), out.stderr


def test_entry_stands_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert 'q_bm25_or_top10' in e.queries() and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_long_documents_match_sql(spark, tmp_path):
    text = " ".join(f"t{i % 997}" for i in range(69_999)) + " last"
    spark.createDataFrame([(1, text), (2, "t1 last word")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("q_tokenize_stats",):
        df = QUERIES[name](spark, str(tmp_path))
        rel = c.sql(ORACLES[name])
        want = sorted((tuple(norm(r[rel.columns.index(n)]) for n in df.columns) for r in rel.fetchall()), key=str)
        assert sorted((tuple(norm(v) for v in r) for r in df.collect()), key=str) == want and want
