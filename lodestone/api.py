"""The search index as one object, its JSON answers, and the small HTTP service."""

from __future__ import annotations

import json
import time
import urllib.parse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import suggest
from lodestone.operators.index import Index, build
from lodestone.operators.progress import Progress, watched
from lodestone.plans import search as plans
from lodestone.plans import store
from lodestone.sources import frame_source, numbered, read_source, settled

RESULTS_PER_REQUEST = 10


class SearchIndex:
    """Build or open an index, then query it. Every query stands alone; column names and boosts ignore case."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.index: Index | None = None
        self.source = ""
        self.progress: Progress | None = None

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, columns: list[str]) -> SearchIndex:
        return cls(spark).index_file(path, columns)

    @classmethod
    def from_dataframe(cls, spark: SparkSession, frame, columns: list[str], id_col: str | None = None) -> SearchIndex:
        return cls(spark).index_frame(frame, columns, id_col)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        out = cls(spark)
        out.index = store.load(spark, path)
        return out

    def index_file(self, path: str, columns: list[str]) -> SearchIndex:
        self.source = path
        return self.index_frame(read_source(self.spark, path), columns)

    def index_frame(self, frame, columns: list[str], id_col: str | None = None) -> SearchIndex:
        """A Spark, pandas, Arrow or Polars frame; rows are numbered in order unless ``id_col`` names their id.

        A numbered table is written to the shared folder, so that every later use has the same numbers.
        """
        df = frame_source(self.spark, frame)
        own = id_col.upper() if id_col else "DOC_ID" if "DOC_ID" in df.columns else None
        self.index = build(df if own else settled(numbered(df), "documents"), columns, own or "DOC_ID")
        return self

    def persist(self) -> SearchIndex:
        """Keep the index's tables in the executors' memory and disk: build once, query often. ``progress`` tells how far that is."""
        with watched(self.spark) as self.progress:
            index = self._built.persist()
            for table in (index.postings, index.terms, index.stats):
                table.count()
        return self

    def n_docs(self) -> int:
        """Documents in the index."""
        return max((r.n_docs for r in self._built.statistics().values()), default=0)

    def save(self, path: str | None = None) -> str:
        path = path or store.default_path(self.source)
        store.save(self._built, path, self.source)
        return path

    @property
    def _built(self) -> Index:
        if self.index is None:
            raise ValueError("nothing is indexed yet")
        return self.index

    def columns(self) -> list[str]:
        return [c.upper() for c in self._built.documents.columns]

    def search_columns(self) -> list[str]:
        return [c.upper() for c in self._built.fields]

    def query(self, texts: dict[str, str], boosts: dict[str, float] | None = None, k: int = 10, **options) -> DataFrame:
        return plans.search(self._built, texts, k, boosts, **options)

    def query_ids(self, texts: dict[str, str], boosts: dict[str, float] | None = None, k: int = 10, **options) -> DataFrame:
        return plans.search_ids(self._built, texts, k, boosts, **options)

    def query_arrays(self, texts: dict[str, str], boosts: dict[str, float] | None = None, k: int = 10, **options) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the results, best first; empty arrays without results."""
        rows = self.query_ids(texts, boosts, k, **options).collect()
        return np.array([r.doc_id for r in rows], np.int64), np.array([r.score for r in rows], np.float32)

    def query_dicts(self, texts: dict[str, str], boosts: dict[str, float] | None = None, k: int = 10, **options) -> list[dict[str, str]]:
        """Results as dicts of strings with upper-cased names and SCORE with four decimals."""
        return [json.loads(r[0]) for r in json_rows(self.query(texts, boosts, k, **options)).collect()]

    def search_json(self, parameters: str) -> str:
        """The answer to ``COL=text&COL=text``; names that aren't search columns are left out, as is SCORE."""
        began = time.perf_counter()
        given = {n.upper(): v for n, v in urllib.parse.parse_qsl(parameters, keep_blank_values=True)}
        results = self.query_dicts({n: v for n, v in given.items() if n in self.search_columns()}, k=RESULTS_PER_REQUEST)
        return json.dumps({"results": results, "time_taken_us": int((time.perf_counter() - began) * 1e6)}, ensure_ascii=False)

    def vocabulary(self, field: str) -> DataFrame:
        """(key, score): the terms of a field with their document frequency."""
        return self._built.terms.where(F.col("field") == field.upper()).select(F.col("term").alias("key"), F.col("df").alias("score"))

    def suggest(self, field: str, prefix: str, k: int = 10) -> DataFrame:
        return suggest.prefix_top(self.vocabulary(field), prefix.upper(), k)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object of strings for each result row, names upper-cased, null as an empty string."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c.upper()) for c in rows.columns if c != "SCORE"]
    return rows.select(F.to_json(F.struct(*named, scoring.shown(F.col("SCORE")).alias("SCORE"))).alias("json"))


def details(row: DataFrame) -> DataFrame:
    """(key, value) of one result row, by key."""
    pairs = F.array(*(F.struct(F.lit(c.upper()).alias("key"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("p")).select("p.key", "p.value").orderBy("key")


def search_first(index: Index, rows: DataFrame) -> DataFrame:
    """Result columns with the search columns in front."""
    front = [c for c in rows.columns if c in index.fields]
    return rows.select(*front, *(c for c in rows.columns if c not in front))


def serve(index: SearchIndex, port: int = 5000):
    """An HTTP server (not started) with /search, /get_columns, /get_search_columns and /healthcheck."""
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urllib.parse.urlsplit(self.path)
            answers = {
                "/search": lambda: index.search_json(url.query),
                "/get_columns": lambda: json.dumps({"columns": [*index.columns(), "SCORE"]}),
                "/get_search_columns": lambda: json.dumps({"columns": index.search_columns()}),
                "/healthcheck": lambda: "",
            }
            found = answers.get(url.path)
            body = found().encode() if found else b""
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
