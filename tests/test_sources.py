import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.operators.index import build
from lodestone.plans import search
from lodestone.streaming.incremental import index_stream, open_segments


def test_csv_quoting(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,title,"last, one"\n1,"a ""b"" c","x\ny"\n2,,"p,q"\n3,plain,"end"\n')
    rows = sources.read_source(spark, str(path)).collect()
    assert rows[0].asDict() == {"ID": "1", "TITLE": 'a "b" c', "LAST, ONE": "x\ny"}
    assert [r.ID for r in rows] == ["1", "2", "3"] and rows[1]["LAST, ONE"] == "p,q"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"id": 1, "text": "say \\"hi\\" \\\\ ok", "n": -3.14}\n{"text": "other order", "id": 2, "flag": true, "none": null}\n{"id": 3, "n": 7}\n')
    df = sources.read_source(spark, str(path))
    assert {"ID", "TEXT", "N", "FLAG"} <= set(df.columns)
    got = {r.ID: r for r in df.collect()}
    assert got["1"].TEXT == 'say "hi" \\ ok' and got["1"].N == "-3.14" and got["2"].FLAG == "true" and got["3"].TEXT is None


def test_other_suffixes_are_refused(spark):
    with pytest.raises(ValueError):
        sources.read_source(spark, "x.txt")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', [1, 2]), (2, None, None), (3, "", [])], "id long, t string, xs array<int>")
    sources.to_csv(df, str(tmp_path / "t.csv"))
    back = {r.ID: r for r in sources.read_source(spark, str(tmp_path / "t.csv")).collect()}
    assert back["1"].T == 'a "q"\nb' and back["1"].XS == "[1,2]" and not back["2"].T
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert sources.read_source(spark, str(tmp_path / "t.parquet")).columns == ["ID", "T", "XS"]
    assert sources.parquet_metadata(spark, str(tmp_path / "t.parquet")).agg(F.sum("rows")).first()[0] == 3


@pytest.mark.parametrize("make", [pd.DataFrame, lambda d: pa.table(d)])
def test_frames(spark, make):
    df = sources.frame_source(spark, make({"id": [1, 2], "words": ["x y", "y"]}))
    assert df.columns == ["ID", "WORDS"]
    assert [r.doc_id for r in search.search_ids(build(df, ["words"], "id"), {"words": "x"}).collect()] == [1]


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("x"))
    got = sources.numbered(df).select("DOC_ID").collect()
    assert sorted(r[0] for r in got) == list(range(1000))
    assert sources.numbered(spark.createDataFrame([(5,)], "doc_id long")).columns == ["doc_id"]


def test_nested_and_typed_columns_are_searchable(spark):
    df = spark.createDataFrame([(1, [1, 22], 3.5, True), (2, [22], None, False)], "id long, xs array<int>, f double, b boolean")
    index = build(df, ["xs", "f", "b"], "id")
    hits = lambda c, t: [r.doc_id for r in search.search_ids(index, {c: t}).collect()]
    assert hits("xs", "22") == [2, 1] and hits("f", "3.5") == [1] and hits("b", "FALSE") == [2]


def test_json_keys(spark):
    df = spark.createDataFrame([(0, '{"a": 1, "b": null}'), (1, '{"B": 2, "c": "x", "a": 3}'), (2, None), (3, "{}")], "n long, j string")
    assert {(r.key, r.first) for r in sources.json_keys("j", "n", df).collect()} == {("A", 0), ("B", 0), ("C", 1)}


def test_stream_of_files(spark, tmp_path):
    data = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(20)], "id long, text string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: index_stream(spark, src, data.schema, ["text"], "id", out, str(tmp_path / "ck")).awaitTermination()
    data.where("id < 10").write.parquet(src)
    run()
    data.where("id >= 10").write.mode("append").parquet(src)
    run()
    index = open_segments(spark, out, ["text"], "id")
    whole = build(data, ["text"], "id")
    q = {"text": "word1 common"}
    assert search.search_ids(index, q, 20).collect() == search.search_ids(whole, q, 20).collect()


def test_csv_is_split_unless_quotes_span_lines(spark, tmp_path):
    plain, spanning = tmp_path / "p.csv", tmp_path / "s.csv"
    plain.write_text('id,t\n1,"a ""b"", c"\n2,"x"\n')
    spanning.write_text('id,t\n1,"a\nb"\n2,c\n')
    assert not sources.readers.quotes_span_lines(spark, str(plain)) and sources.readers.quotes_span_lines(spark, str(spanning))
    assert [r.T for r in sources.read_source(spark, str(plain)).collect()] == ['a "b", c', "x"]
    assert [r.T for r in sources.read_source(spark, str(spanning)).collect()] == ["a\nb", "c"]


def test_csv_fields(spark):
    df = spark.createDataFrame([('1,"a ""b"", c",',), ("2,x,y",), (None,)], "r string")
    got = [r.f and tuple(r.f) for r in df.select(sources.csv_fields(F.col("r"), ["a", "b b", "c"]).alias("f")).collect()]
    assert got[:2] == [("1", 'a "b", c', None), ("2", "x", "y")] and got[2] is None


def test_rows_by_place_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(50).repartition(4).write.parquet(path)
    files = sorted(f for f in (tmp_path / "many").iterdir() if f.suffix == ".parquet")
    order = [r.id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [sources.row_at(spark, path, i).first().id for i in (0, 17, 49)] == [order[i] for i in (0, 17, 49)]
    assert sources.row_at(spark, path, 50).count() == 0
    groups = sources.parquet_row_groups(spark, str(files[0])).collect()
    assert [g.row_group for g in groups] == list(range(len(groups))) and sum(g.rows for g in groups) == spark.read.parquet(str(files[0])).count()
