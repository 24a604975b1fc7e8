"""Ranked retrieval: disjunctive, conjunctive, phrase-boosted and batched, as one plan each.

A query becomes literal terms on the driver (at most 64 a field), so that ``field = ... and term in (...)`` reaches the
Parquet scan; their weights, looked up once, are literals of the plan too. What is left is one partial and one final sum by
document, then a limit that each task applies before the last merge: no join at all. Rows are fetched for the k results only.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions import scoring
from lodestone.functions.analysis import query_terms, tokens
from lodestone.operators.index import CHUNK, ColumnNotFound, Index
from lodestone.sources import settled

MOST_RESULTS = 1000


class ColumnNotSearchable(ValueError):
    """A column of the table that isn't indexed."""


@dataclass
class Query:
    """Terms with their multiplicity and boost by field, and the neighbouring pairs."""

    weights: dict[tuple[str, str], tuple[int, float]]
    pairs: dict[tuple[str, str, str], int]

    @property
    def fields(self) -> list[str]:
        return sorted({f for f, _ in self.weights})


def parse(index: Index, texts: dict[str, str], boosts: dict[str, float] | None = None) -> Query:
    """Check fields and boosts (any letter case) and split the texts into terms."""
    known, indexed = {c.upper() for c in index.documents.columns}, {f.upper() for f in index.fields}
    for name in texts:
        if name.upper() not in known:
            raise ColumnNotFound(f"no column {name}")
        if name.upper() not in indexed:
            raise ColumnNotSearchable(f"{name} isn't indexed")
    by_name = {n.upper(): float(b) for n, b in (boosts or {}).items()}
    weights: dict[tuple[str, str], tuple[int, float]] = {}
    pairs: Counter[tuple[str, str, str]] = Counter()
    for name, text in texts.items():
        terms = query_terms(text)
        for t, n in Counter(terms).items():
            weights[name.upper(), t] = (n, by_name.get(name.upper(), 1.0))
        pairs.update((name.upper(), a, b) for a, b in pairwise(terms))
    return Query(weights, dict(pairs))


def check_k(k: int) -> int:
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k must be between 1 and {MOST_RESULTS}")
    return k


def term_filter(query: Query) -> Column:
    """The query's terms as literals, which push down to the scan."""
    clauses = [(F.col("field") == f) & F.col("term").isin(sorted(t for g, t in query.weights if g == f)) for f in query.fields]
    return reduce(Column.__or__, clauses) if clauses else F.lit(False)


def matching(index: Index, query: Query, positions: bool = True) -> DataFrame:
    return (index.postings if positions else index.hits()).where(term_filter(query))


@dataclass
class Weights:
    """What the index knows of a query's terms: (times, idf times boost) by field and term, at most 64 a field."""

    terms: dict[tuple[str, str], tuple[int, float]]
    avg_dl: dict[str, float]

    @property
    def iterators(self) -> int:
        return sum(n for n, _ in self.terms.values())

    def column(self, of) -> Column:
        """A literal of each posting's term, by nested conditions that stay inside generated code."""
        chain = None
        for (f, t), value in self.terms.items():
            test = (F.col("field") == f) & (F.col("term") == t)
            chain = F.when(test, of(f, value)) if chain is None else chain.when(test, of(f, value))
        return F.lit(0.0) if chain is None else chain


def query_weights(index: Index, query: Query) -> Weights:
    """Look a query's terms up in the vocabulary: one job over the row groups that may hold them, a bounded result."""
    if not query.weights:
        return Weights({}, {})
    stats = index.statistics()
    found = index.terms.where(term_filter(query)).select("field", "term", "df").collect()
    out = {}
    for r in sorted(found):
        times, boost = query.weights[r.field, r.term]
        out[r.field, r.term] = times, boost * (1 + math.log2(stats[r.field].n_docs / r.df))
    return Weights(out, {f: s.avg_dl for f, s in stats.items()})


def scores(index: Index, query: Query, mode: str = "or", how: str = "bm25", phrases: bool = False, first_place: bool = False) -> DataFrame:
    """(doc_id, score) of every matching document with a positive score; ``auto`` is tf-idf for a single known term, else BM25."""
    if mode not in ("or", "and"):
        raise ValueError("mode is or, or and")
    if how not in ("bm25", "tfidf", "auto"):
        raise ValueError("scoring is bm25, tfidf or auto")
    weights = query_weights(index, query)
    if how == "auto":
        how = "tfidf" if weights.iterators == 1 else "bm25"
    hits = matching(index, query, phrases or first_place)
    weight = weights.column(lambda f, v: F.lit(v[0] * v[1]))
    average = reduce(lambda c, f: c.when(F.col("field") == f, F.lit(weights.avg_dl[f])), sorted(weights.avg_dl), F.when(F.lit(False), F.lit(0.0)))
    score = scoring.bm25(F.col("tf"), F.col("dl"), average, weight) if how == "bm25" else scoring.tfidf(F.col("tf"), weight)
    if first_place:
        times = weights.column(lambda f, v: F.lit(v[0]))
        score = score + F.when(F.array_contains("positions", 0), F.lit(scoring.FIRST_PLACE_BONUS) * times).otherwise(0.0)
    places, pairs = adjacent_pairs(query) if phrases else ([], F.lit(0))
    out = hits.groupBy("doc_id").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("matched"), *places)
    if mode == "and":
        out = out.where(F.col("matched") == len(query.weights))
    return out.select("doc_id", (F.col("score") * F.pow(F.lit(scoring.PHRASE_FACTOR), pairs)).alias("score") if places else "score").where("score > 0")


def adjacent_pairs(query: Query) -> tuple[list[Column], Column]:
    """The places of the terms of neighbouring pairs, as sums by document, and how often such pairs stand next to each other, once for each equal pair of the query."""
    known = sorted({(f, t) for f, a, b in query.pairs for t in (a, b)})
    name = {key: f"__at{i}" for i, key in enumerate(known)}
    places = [F.first(F.when((F.col("field") == f) & (F.col("term") == t), F.col("positions")), ignorenulls=True).alias(name[f, t]) for f, t in known]
    next_to = lambda a, b: F.coalesce(F.array_size(F.array_intersect(F.transform(a, lambda p: p + 1), b)), F.lit(0))
    each = [n * next_to(F.col(name[f, a]), F.col(name[f, b])) for (f, a, b), n in query.pairs.items()]
    return places, reduce(Column.__add__, each, F.lit(0))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(doc_id, score) best first, rounded to six decimals; equal scores by id."""
    return scored.select("doc_id", scoring.rounded(F.col("score")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(check_k(k))


def search_ids(index: Index, texts: dict[str, str], k: int = 10, boosts: dict[str, float] | None = None, **options) -> DataFrame:
    check_k(k)
    return top(scores(index, parse(index, texts, boosts), **options), k)


#: Values up to which Spark pushes a list down to a scan as such, and not as its range.
PUSHED = 10


def fetch(index: Index, best: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All source columns (but one named SCORE) of ranked documents, and the score.

    The hits, at most MOST_RESULTS, are collected: their ids are literals of the scan, which skips row groups without them.
    """
    hits = [(r.doc_id, r.score) for r in best.select("doc_id", "score").collect() if r.doc_id is not None]
    ids = sorted(d for d, _ in hits)
    plain = isinstance(index.documents.schema[index.id_col].dataType, T.IntegralType)
    own = F.col(f"`{index.id_col}`") if plain else F.col(f"`{index.id_col}`").cast("long")
    wanted = reduce(Column.__or__, (own.isin(ids[i : i + PUSHED]) for i in range(0, len(ids), PUSHED)), F.lit(False))
    found = F.broadcast(index.documents.sparkSession.createDataFrame(hits, "__hit long, __score double"))
    rows = index.documents.where(wanted).join(found, own == F.col("__hit"))
    names = columns or [c for c in index.documents.columns if c.upper() != "SCORE"]
    ranked = rows.select(*(F.col(f"`{c}`") for c in names), F.col("__score").alias("SCORE"), "__hit").orderBy(F.desc("SCORE"), "__hit")
    return ranked.limit(MOST_RESULTS).drop("__hit")  # each task sorts its own few rows


def search(index: Index, texts: dict[str, str], k: int = 10, boosts: dict[str, float] | None = None, **options) -> DataFrame:
    return fetch(index, search_ids(index, texts, k, boosts, **options))


#: Once a guess at scores; ranking by chunks needs none, and it has no effect any more.
GUESS = 4
#: Pairs of a query and a term that one group of the batch holds at most, and that are broadcast at most.
PAIRS, BROADCAST_PAIRS = 1 << 20, 1 << 17


def batch(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank, score) for a table (query_id, field, text) of queries: all of them at once, disjunctive BM25.

    Every matching document gets its exact score, but no table of queries and documents is made: the postings of the queries'
    terms are grouped, packed, by chunks of documents, and each chunk gives the k best of every query. Queries are cut into
    blocks of about PAIRS terms, each of which meets all chunks. Queries without an id have no result; ids of documents are
    taken to be unique (rows that share one may be ranked apart).
    """
    check_k(k)
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", F.upper("field").alias("field"), F.explode(tokens("text", most=None)).alias("term"))
    asked = asked.groupBy("query_id", "field", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.join(index.terms.join(F.broadcast(index.stats), "field"), ["field", "term"])  # a row of statistics for each indexed column
    asked = settled(asked.select("query_id", "field", "term", "df", "avg_dl", (F.col("times") * scoring.idf(F.col("n_docs"), F.col("df"))).alias("weight")), "asked")
    pairs = asked.count()
    block = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(-(-pairs // PAIRS) or 1)).alias("block")
    by_term = asked.groupBy(block, "field", "term").agg(F.first("avg_dl").alias("avg_dl"), F.collect_list("query_id").alias("queries"), F.collect_list("weight").alias("weights"))
    chunks = chunked(index, asked.select("field", "term", "df").distinct())
    rows = chunks.join(F.broadcast(by_term) if pairs <= BROADCAST_PAIRS else by_term, ["field", "term"])
    kind = asked.schema["query_id"].dataType

    def best(group: pa.Table) -> pa.Table:
        return best_of_chunk(group, k)

    result = T.StructType([T.StructField("query_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = rows.groupBy("chunk", "block").applyInArrow(best, result)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def chunked(index: Index, terms: DataFrame) -> DataFrame:
    """(chunk, field, term, doc_ids, tfs, dls): packed postings of at least these terms, with all of a document in one chunk.

    The chunks are the index's own if it has one field, as a document is one text then; else its ids are dealt out to
    as many chunks as the terms' postings need.
    """
    if index.packed is not None and len(index.fields) == 1:
        return index.packed.select("chunk", "field", "term", "doc_ids", "tfs", "dls")
    n = -(-(terms.agg(F.sum("df")).first()[0] or 0) // CHUNK) or 1
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("chunk")
    rows = index.hits().join(terms.select("field", "term"), ["field", "term"], "left_semi")
    rows = rows.groupBy(chunk, "field", "term").agg(F.collect_list(F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))).alias("p"))
    return rows.select("chunk", "field", "term", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def best_of_chunk(rows: pa.Table, k: int) -> pa.Table:
    """(query_id, doc_id, score): the k best documents of a chunk for each query, scores rounded to six decimals, equal ones by id.

    A row is a term's postings (doc_ids, tfs, dls) with its queries and their weights. Scores are summed up query by query,
    in order of field and term, so that equal texts have equal scores.
    """
    rows = rows.combine_chunks()
    size = pc.list_value_length(rows["doc_ids"]).to_numpy()
    flat = lambda name: pc.list_flatten(rows[name]).combine_chunks()
    docs, place = np.unique(flat("doc_ids").to_numpy(zero_copy_only=False), return_inverse=True)
    tf, dl = (flat(name).to_numpy().astype(np.float64) for name in ("tfs", "dls"))
    share = scoring.bm25(tf, dl, np.repeat(rows["avg_dl"].to_numpy(), size), 1.0)
    end = np.cumsum(size)
    begin = end - size
    query = flat("queries").dictionary_encode()
    code, weight = query.indices.to_numpy(), flat("weights").to_numpy()
    of = np.repeat(np.arange(len(size)), pc.list_value_length(rows["queries"]).to_numpy())
    turn = np.empty(len(size), np.int64)
    turn[pc.sort_indices(rows.select(["field", "term"]), [("field", "ascending"), ("term", "ascending")]).to_numpy()] = np.arange(len(size))
    order = np.lexsort((turn[of], code))
    code, of, weight = code[order], of[order], weight[order]
    heads = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)) if len(code) else np.zeros(1, np.int64)
    codes, ids, scores = [], [], []
    for a, b in pairwise(heads.tolist()):
        spans = [(slice(begin[r], end[r]), w) for r, w in zip(of[a:b].tolist(), weight[a:b].tolist(), strict=True)]
        total = np.bincount(np.concatenate([place[s] for s, _ in spans]), np.concatenate([w * share[s] for s, w in spans]), len(docs))
        found = np.flatnonzero(total > 0)
        score = np.floor(total[found] * 1e6 + 0.5) / 1e6
        if len(found) > k:
            edge = np.partition(score, len(found) - k)[len(found) - k]
            above = np.flatnonzero(score > edge)
            kept = np.append(above, np.flatnonzero(score == edge)[: k - len(above)])
            found, score = found[kept], score[kept]
        codes.append(np.full(len(found), code[a]))
        ids.append(docs[found])
        scores.append(score)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    columns = [query.dictionary.take(pa.array(join(codes, np.int32))), pa.array(join(ids, np.int64), pa.int64()), pa.array(join(scores, np.float64))]
    return pa.Table.from_arrays(columns, ["query_id", "doc_id", "score"])
