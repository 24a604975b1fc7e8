"""Extension beyond a one-off build: new files become segments of postings through Structured Streaming.

A segment holds documents and postings only; document frequencies and averages are summed over all segments when the index
is opened, so a batch that is replayed after a failure overwrites its own segment and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.index import Index, build, field_stats, lengths, term_table, unpacked


def index_stream(spark: SparkSession, source: str, schema: StructType, fields: list[str], id_col: str, path: str, checkpoint: str) -> StreamingQuery:
    """Index the Parquet files that lie in ``source`` or arrive there; ends when all that has arrived is done."""

    def segment(batch: DataFrame, number: int) -> None:
        part = build(batch, fields, id_col)
        batch.write.mode("overwrite").parquet(f"{path}/documents/segment={number}")
        part.packed.write.mode("overwrite").parquet(f"{path}/postings/segment={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_segments(spark: SparkSession, path: str, fields: list[str], id_col: str) -> Index:
    documents, packed = (spark.read.parquet(f"{path}/{t}").drop("segment") for t in ("documents", "postings"))
    terms = term_table(packed)
    return Index(documents, id_col, fields, unpacked(packed), terms, lengths(documents, id_col, fields), field_stats(documents, fields, terms), packed, kept=True)
