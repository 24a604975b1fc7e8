"""The inverted index as ordinary tables.

One narrow pass splits every search column into terms and packs the postings of some thousand documents at a time: a row for
each term of such a chunk, in order of term, with its postings in order of id. That needs no shuffle and no sort by Spark. Only
the term table is a shuffle, of the chunks' counts. Postings carry the document's length, so ranking needs no join with a
length table, however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.analysis import LONGEST_TERM, as_text
from lodestone.sources import bound_batches, settled

BLOCK = 64


class ColumnNotFound(ValueError):
    """A column that the table doesn't have."""


@dataclass
class Index:
    """documents (DOC_ID and every source column), postings (field, term, doc_id, tf, dl, positions), terms (field, term, df, cf), doc_len (field, doc_id, dl), stats (field, n_docs, avg_dl).

    ``packed`` holds the same postings by chunks, as PACKED says; a saved index has none. A text's postings lie in one chunk.
    """

    documents: DataFrame
    id_col: str
    fields: list[str]
    postings: DataFrame
    terms: DataFrame
    doc_len: DataFrame
    stats: DataFrame
    packed: DataFrame | None = None
    kept: bool = False
    _stats: dict[str, Row] = field(default_factory=dict)

    def settle(self) -> Index:
        """Write the packed postings to the shared folder, so that texts are split once; a query's terms skip row groups there."""
        if self.packed is not None and not self.kept:
            self.packed = settled(self.packed, "postings", {"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES})
            self.kept = True
            self.postings, self.terms = unpacked(self.packed), term_table(self.packed)
            self.stats = field_stats(self.documents, self.fields, self.terms)
        return self

    def persist(self) -> Index:
        """Keep the tables: postings in the shared folder, terms and statistics in memory and on disk."""
        self.settle()
        self.terms = self.terms.sortWithinPartitions("field", "term").persist()
        self.stats = field_stats(self.documents, self.fields, self.terms).persist()
        return self

    def hits(self) -> DataFrame:
        """The postings without positions, which are not read then."""
        return self.postings.drop("positions") if self.packed is None else unpacked(self.packed, positions=False)

    def statistics(self) -> dict[str, Row]:
        """n_docs and avg_dl by field: one row for each indexed column, read once."""
        if not self._stats:
            self._stats = {r.field: r for r in self.stats.collect()}
        return self._stats


def search_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The table's own spelling of the columns asked for, in the order asked for, ignoring case."""
    known = {c.upper(): c for c in df.columns}
    missing = [n for n in names if n.upper() not in known]
    if missing:
        raise ColumnNotFound(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return list(dict.fromkeys(known[n.upper()] for n in names))


def field_texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, doc_id, text): one row for each document and field; all fields in one pass over the table."""
    each = F.array(*(F.struct(F.lit(f.upper()).alias("field"), as_text(f"`{f}`", df.schema[f].dataType).alias("text")) for f in fields))
    rows = bound_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.explode(each).alias("f"))
    return rows.select("f.field", "doc_id", "f.text")


def spread(df: DataFrame) -> DataFrame:
    """A table of few splits over all cores, before the costly part; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Row groups of packed postings: small, so that a query's terms lie in few of them.
ROW_GROUP_BYTES = 4 << 20
#: Bytes of text that are split at a time, and terms of a chunk of packed postings; a longer single text is a chunk of its own.
SLICE, CHUNK = 1 << 21, 1 << 21

PACKED = "field string, term string, df int, cf long, doc_ids array<long>, tfs array<int>, dls array<int>, positions array<array<int>>, chunk long"
LENGTHS = "field string, doc_id long, dl int"

#: By byte: what belongs to a term, and its upper case. The terms are those of functions.analysis.tokens.
_IN_TERM = np.array([b >= 127 or chr(b).isalnum() for b in range(256)])
_UPPER = np.array([b - 32 if 97 <= b <= 122 else b for b in range(256)], np.uint8)


def split_terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows in order, and how many each row has."""
    text = text.cast(pa.string()).fill_null("")
    if not len(text):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row's end is a term's
    edge[at] = True
    begin = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    size = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1 - begin
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(_UPPER[raw[inside[1:-1]]]))
    first = np.searchsorted(begin, at)
    long = np.flatnonzero(size > LONGEST_TERM)
    return _cut(terms, np.diff(first), long) if len(long) else (terms, np.diff(first))


def _cut(terms: pa.Array, count: np.ndarray, long: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut terms of more than LONGEST_TERM characters; ``long`` are the places of those that may be."""
    out, pieces, done = [], np.ones(len(terms), np.int64), 0
    for i in long.tolist():
        t = terms[i].as_buffer().to_pybytes().decode(errors="replace")
        cut = [t[j : j + LONGEST_TERM] for j in range(0, len(t), LONGEST_TERM + 1)]
        out += [terms.slice(done, i - done), pa.array(cut, pa.string())]
        pieces[i], done = len(cut), i + 1
    upto = np.append(0, np.cumsum(pieces))
    rows = np.append(0, np.cumsum(count))
    return pa.concat_arrays([*out, terms.slice(done)]), np.diff(upto[rows])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _lists(values: pa.Array, heads: np.ndarray) -> pa.Array:
    """Lists of neighbouring values, each from one of ``heads`` to the next."""
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), values)


def _chunk_name(ids: np.ndarray) -> np.int64:
    """A chunk's name: a hash of its documents' ids, so that a task that runs again gives the same one."""
    return np.frombuffer(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), np.int64)[0]


def _pack(parts: list[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """A chunk of (fields, ids, terms, number of terms by row) as PACKED rows, by field and term."""
    fields = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    ids = np.concatenate([p[1].to_numpy(zero_copy_only=False) for p in parts])
    terms = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
    size = np.concatenate([p[3] for p in parts])
    by_field, by_term = pc.sort_indices(fields.dictionary), pc.sort_indices(terms.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    group = np.empty(len(by_field), np.int64)
    group[by_field.to_numpy()] = np.arange(len(by_field))
    group = group[fields.indices.to_numpy()]
    row = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[row] = np.arange(len(ids))
    # One number for field, term and document: a chunk's terms times its rows stay far below 2^63.
    key = np.repeat(group * len(by_term) * len(ids) + place, size) + rank[terms.indices.to_numpy()] * len(ids)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of, doc = np.divmod(key[head], len(ids))
    top = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    doc, tf = row[doc], np.diff(head, append=len(key)).astype(np.int32)
    at = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
    which = of[top]
    columns = [
        fields.dictionary.take(by_field.take(pa.array(which // len(by_term)))),
        terms.dictionary.take(by_term.take(pa.array(which % len(by_term)))),
        pa.array(np.diff(top, append=len(head)).astype(np.int32)),
        pa.array(np.add.reduceat(tf, top, dtype=np.int64)),
        _lists(pa.array(ids[doc]), top),
        _lists(pa.array(tf), top),
        _lists(pa.array(size[doc].astype(np.int32)), top),
        _lists(_lists(pa.array(at), head), top),
        pa.array(np.full(len(top), _chunk_name(ids))),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in slices(batches):
        terms, size = split_terms(batch.column("text"))
        if parts and held + len(terms) > CHUNK:
            yield _pack(parts)
            parts, held = [], 0
        if len(terms):
            parts.append((batch.column("field"), batch.column("doc_id"), terms, size))
            held += len(terms)
    if parts:
        yield _pack(parts)
    pa.default_memory_pool().release_unused()  # worker processes outlive their tasks


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        _, size = split_terms(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("doc_id"), pa.array(size.astype(np.int32))], ["field", "doc_id", "dl"])


def unpacked(packed: DataFrame, positions: bool = True) -> DataFrame:
    """(field, term, doc_id, tf, dl, positions): a row for each posting; conditions on field and term reach the packed table."""
    lists = ["doc_ids", "tfs", "dls", *(["positions"] if positions else [])]
    each = packed.select("field", "term", F.inline(F.arrays_zip(*lists)))
    return each.withColumnsRenamed({"doc_ids": "doc_id", "tfs": "tf", "dls": "dl"})


def term_table(packed: DataFrame) -> DataFrame:
    return packed.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def field_stats(df: DataFrame, fields: list[str], terms: DataFrame) -> DataFrame:
    """(field, n_docs, avg_dl) from the number of rows and the terms' counts; documents without terms count in both figures."""
    rows = df.agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 0").select("n_docs", F.explode(F.array(*(F.lit(f.upper()) for f in fields))).alias("field"))
    totals = terms.groupBy("field").agg(F.sum("cf").alias("total"))
    return rows.join(totals, "field", "left").select("field", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_dl"))


def _texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    return field_texts(spread(df.select(id_col, *[f for f in fields if f != id_col])), id_col, fields)


def lengths(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, doc_id, dl) of every document, without terms too."""
    return _texts(df, id_col, fields).mapInArrow(_lengths, LENGTHS)


def build(df: DataFrame, fields: list[str], id_col: str) -> Index:
    """Declare the index of a table; nothing runs before a table of it is used."""
    fields = search_columns(df, fields)
    (id_col,) = search_columns(df, [id_col])
    packed = _texts(df, id_col, fields).mapInArrow(_packed, PACKED)
    terms = term_table(packed)
    return Index(df, id_col, fields, unpacked(packed), terms, lengths(df, id_col, fields), field_stats(df, fields, terms), packed)


def block_maxima(post: DataFrame, block: int = BLOCK, span: int = 1 << 16) -> DataFrame:
    """(field, term, block, max_tf, max_doc_id, max_tf_dl): bounds for each run of ``block`` postings of a term, in order of id.

    Postings are numbered within spans of ids and spans by running counts, so the commonest term is spread over as many
    tasks as there are spans; what one window orders is a span's postings, or a term's spans.
    """
    post = post.withColumn("span", F.floor(F.col("doc_id") / span))
    terms = Window.partitionBy("field", "term").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = post.groupBy("field", "term", "span").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(terms), F.lit(0))).drop("n")
    within = Window.partitionBy("field", "term", "span").orderBy("doc_id")
    placed = post.withColumn("place", F.row_number().over(within) - 1).join(before, ["field", "term", "span"])
    blocks = placed.withColumn("block", F.floor((F.col("before") + F.col("place")) / block).cast("int"))
    return blocks.groupBy("field", "term", "block").agg(F.max("tf").alias("max_tf"), F.max("doc_id").alias("max_doc_id"), F.min(F.struct((-F.col("tf")).alias("t"), "dl")).getField("dl").alias("max_tf_dl"))
