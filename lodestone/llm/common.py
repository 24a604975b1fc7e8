"""Shared helpers: bounded Arrow slices, checkpoints and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import bound_batches

#: Code units of text that one numpy pass holds at a time (a longer single text is a slice of its own).
SLICE = 1 << 20


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id, text); null texts become empty, other columns are left out."""
    bound_batches(docs)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # worker processes outlive their tasks


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def partial_batch(schema: str, rows: int, /, **given: pa.Array) -> pa.RecordBatch:
    """A batch of a schema's columns, null where they aren't given."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, _KINDS[k]) for c, k in fields], [c for c, _ in fields])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string column without nulls, and the offsets of its rows (one more than rows)."""
    texts = col.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return raw, (off - off[0]) if len(texts) else np.zeros(1, np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a folder of our own only where none is set in local mode, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def settle_table(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for what is large: columns are compressed and pruned when read.

    The table's path is added to ``paths``, for ``clear_tables``.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove settled tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def gather(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """A table of at most so many rows in as many partitions as they need, where a shuffle would give it more: small tables aren't many small files."""
    parts = max(1, -(-rows // each))
    return df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


U = np.uint64
_rng = np.random.default_rng(20240229)
#: Two independent random 64-bit values for every byte, for polynomial hashes modulo 2**64.
BYTE_NAMES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
BASE_INV = np.array([pow(int(b), -1, 2**64) for b in BASE], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class RollingHash:
    """Hashes of arbitrary ranges of one byte array by prefix sums; ``which`` chooses one of two independent families."""

    def __init__(self, raw: np.ndarray, which: int = 0) -> None:
        n = len(raw)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_NAMES[which][raw] * powers(BASE[which], n), out=self.prefix[1:])
        self.inverse = powers(BASE_INV[which], n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)
