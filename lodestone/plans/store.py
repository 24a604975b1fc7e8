"""An index on disk: four Parquet tables and a description.

Postings lie below their field, range-sorted by term, and documents range-sorted by id, both in small row groups: a query
reads the row groups of its terms, and of its results. Documents are tokenised once; their lengths stand in the postings.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators.index import Index, field_stats, lengths

TABLES = ("documents", "postings", "terms", "stats")


def default_path(source: str, root: str = "lodestone_data") -> str:
    """Where the index of a source lies unless a path is given: indexing the same source again replaces it."""
    return f"{root}/{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def save(index: Index, path: str, source: str = "", row_group_bytes: int = 4 << 20) -> None:
    """Write all tables, replacing what lies there. Terms and statistics are counted from the written postings."""
    spark = index.settle().documents.sparkSession
    by_id = index.documents.repartitionByRange(F.col(f"`{index.id_col}`")).sortWithinPartitions(F.col(f"`{index.id_col}`"))
    by_id.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(f"{path}/documents")
    ordered = index.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
    ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).partitionBy("field").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    by_term = written.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    by_term.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/terms")
    counted = field_stats(spark.read.parquet(f"{path}/documents"), index.fields, spark.read.parquet(f"{path}/terms"))
    counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    meta = {"source": source, "id_col": index.id_col, "columns": index.documents.columns, "search_columns": index.fields, "k1": scoring.K1, "b": scoring.B}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    documents, id_col, fields = table("documents"), meta["id_col"], meta["search_columns"]
    return Index(documents, id_col, fields, table("postings"), table("terms"), lengths(documents, id_col, fields), table("stats"))
