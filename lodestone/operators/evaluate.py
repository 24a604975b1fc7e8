"""Retrieval quality: precision, recall, average precision and nDCG at k, documents that hold a passage, and percentiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.analysis import LONGEST_TERM, tokens
from lodestone.operators.index import Index, slices, split_terms
from lodestone.sources import bound_batches, settled


def judged(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query of ``qrels`` (query_id, doc_id, grade): the four measures of ``run`` (query_id, doc_id, rank from 1)."""
    relevant = qrels.where("grade > 0")
    by_grade = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = relevant.withColumn("i", F.row_number().over(by_grade)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("idcg"))
    hits = run.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id",
        (zero("found") / k).alias("precision"),
        (zero("found") / F.col("n_rel")).alias("recall"),
        (zero("precisions") / F.col("n_rel")).alias("average_precision"),
        (zero("dcg") / F.col("idcg")).alias("ndcg"),
    )


def metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: the means over all judged queries."""
    names = {"precision": "p_at_k", "recall": "recall_at_k", "average_precision": "map_at_k", "ndcg": "ndcg_at_k"}
    return judged(run, qrels, k).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(n) for c, n in names.items()))


#: Passages, and bytes of them, that every task may hold.
HELD_PASSAGES, HELD_BYTES = 1 << 16, 8 << 20


def containing(index: Index, field: str, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents whose ``field`` holds a passage of (query_id, text), letter for letter.

    All but the first and last term of a passage stand as whole terms in such a document, so only documents with the rarest
    of them are searched: where their texts are read, if tasks can hold all passages, so that no text is shuffled; else its
    postings propose documents, which are joined by id. A passage of fewer than three terms, or with one that is as
    long as terms get, has no such term and is searched for in all documents.
    """
    name = next(f for f in index.fields if f.upper() == field.upper())
    words = passages.select("query_id", F.col("text").alias("passage"), tokens("text", most=None).alias("terms"))
    sure = (F.size("terms") > 2) & ~F.exists("terms", lambda t: F.length(t) >= LONGEST_TERM)
    known = index.terms.where(F.col("field") == field.upper()).select("term", "df")
    inner = words.where(sure).select("query_id", "passage", F.explode(F.array_distinct(F.expr("slice(terms, 2, size(terms) - 2)"))).alias("term"))
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")
    rarest = inner.join(known, "term", "left").groupBy("query_id", "passage").agg(F.min(order).alias("r")).where("r.df > 0")
    rarest = settled(rarest.select(F.monotonically_increasing_id().alias("n"), "query_id", "passage", F.col("r.term").alias("term")), "passages")
    documents = index.documents.select(F.col(f"`{index.id_col}`").cast("long").alias("doc_id"), F.col(f"`{name}`").alias("whole"))
    held = rarest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    if held.n <= HELD_PASSAGES and held.bytes <= HELD_BYTES:
        found = bound_batches(documents.select("doc_id", F.col("whole").cast("string").alias("text"))).mapInArrow(_holding(rarest), "n long, doc_id long")
        found = found.join(F.broadcast(rarest.select("n", "query_id")), "n").select("query_id", "doc_id")
    else:
        post = index.hits().where(F.col("field") == field.upper()).select("term", "doc_id")
        proposed = rarest.join(post, "term").select("query_id", "passage", "doc_id")
        found = proposed.join(documents, "doc_id").where(F.col("whole").contains(F.col("passage"))).select("query_id", "doc_id")
    short = words.where(~sure).select("query_id", "passage")
    if not short.isEmpty():
        found = found.unionByName(documents.join(short, F.col("whole").contains(F.col("passage"))).select("query_id", "doc_id"))
    return found


def _holding(rarest: DataFrame):
    """What gives (n, doc_id) of the texts that hold a passage of (n, passage, term), a table that tasks can hold."""
    by_term: dict[str, list[tuple[int, bytes]]] = {}
    for r in rarest.select("n", "passage", "term").collect():
        by_term.setdefault(r.term, []).append((r.n, r.passage.encode()))
    passages = list(by_term.values())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(list(by_term), pa.string())
        for batch in slices(batches):
            words, size = split_terms(batch.column("text"))
            term = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy()
            at = np.flatnonzero(term >= 0)
            row = np.searchsorted(np.cumsum(size), at, side="right")
            rows, numbers, last, text = [], [], -1, b""
            for i, t in zip(*(x.tolist() for x in np.divmod(np.unique(row * len(terms) + term[at]), max(len(terms), 1))), strict=True):
                if i != last:
                    last, text = i, batch.column("text")[i].as_buffer().to_pybytes()
                here = [n for n, passage in passages[t] if passage in text]
                numbers += here
                rows += [i] * len(here)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column("doc_id").take(pa.array(rows, pa.int64()))], ["n", "doc_id"])
        pa.default_memory_pool().release_unused()  # worker processes outlive their tasks

    return search


#: Ranges of values that are summed up before ranks are counted within each.
SPANS = 1024


def nearest_ranks(df: DataFrame, column: str, parts: int = 100) -> DataFrame:
    """(p, value) for p of 0 to parts-1: the value of a number column at place p * floor(n / parts) in order; nothing for fewer rows than parts.

    Values are counted first. Running counts are taken over SPANS ranges of values, then within each range.
    """
    value = F.col(column)
    counts = settled(df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")), "counts")
    all_ = counts.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    step = all_.n // parts
    if not step:
        return counts.select(F.lit(0).cast("long").alias("p"), "value").limit(0)
    width = (all_.high - all_.low) / SPANS or 1.0
    counts = counts.withColumn("span", F.floor((F.col("value") - all_.low) / width))
    sums = counts.groupBy("span").agg(F.sum("n").alias("in_span"))  # SPANS + 1 rows
    before = sums.select("span", (F.sum("in_span").over(Window.orderBy("span")) - F.col("in_span")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("span").orderBy("value"))
    placed = counts.withColumn("upto", within).join(F.broadcast(before), "span").withColumn("upto", F.col("upto") + F.col("before"))
    first, last = F.ceil((F.col("upto") - F.col("n")) / step), F.least(F.ceil(F.col("upto") / step), F.lit(parts)) - 1
    return placed.where(first <= last).select(F.explode(F.sequence(first, last)).alias("p"), "value")
