"""The registered queries of the corpus operators: one for each, over whole tables, and SQL where there is some."""

import re

import duckdb
import pytest

from lodestone.llm import queries

COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    6: "doc_id n_assign n_access n_hex base_sha256 spans",
    7: "doc_id fingerprint component_id",
    8: "doc_id size source_size target taken",
    9: "doc_id held_out n_tokens n_known train_tokens base_score score",
    10: "doc_id held_out score predicted",
}


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline"] == list(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, number):
    name = next(n for n in queries.queries() if n.startswith(f"op{number}_"))
    df = queries.queries()[name](spark, sf)
    assert set(COLUMNS[number].split()) <= set(df.columns)
    rows = df.collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert {r.doc_id for r in rows} == set(docs) and (number == 3 or len(rows) == len(docs))
    if name in queries.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        want = con.sql(queries.oracle_sql()[name])
        assert sorted(want.columns) == sorted(df.columns)
        key = lambda r: str(r[0])
        assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=key) == sorted(want.fetchall(), key=key)
