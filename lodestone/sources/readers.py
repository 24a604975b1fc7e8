"""Files and frames as DataFrames with upper-cased column names; the suffix decides how a file is read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir; a folder of our own where none is set in local mode)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Rows of a batch that Spark sends to Python, unless the session says otherwise: Spark's default of 10,000 whole texts can fill an executor.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, 1_000


def bound_batches(docs: DataFrame) -> DataFrame:
    """The same table; its session now sends texts in smaller batches, if it had Spark's default."""
    name, default, rows = BATCH_ROWS
    if int(docs.sparkSession.conf.get(name)) == default:
        docs.sparkSession.conf.set(name, rows)
    return docs


def settled(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """The table as written to the shared folder, so that it is computed once and reads alike every time."""
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upper_names(df: DataFrame) -> DataFrame:
    names = [n.upper() if n.isascii() else "".join(c.upper() if c.isascii() else c for c in n) for n in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names differ in case alone")
    return df.toDF(*names)


def read_source(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """A .csv (header, RFC 4180 quoting, line breaks inside quotes), .json (one object a line) or .parquet file.

    A CSV file is split among tasks, unless a quoted field in it spans lines.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=quotes_span_lines(spark, path))
    elif suffix == "json":
        df = spark.read.json(path, primitivesAsString=True)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: only .csv, .json and .parquet files are read")
    return upper_names(df) if upper else df


def quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes: then a field goes on in the next one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_fields(record: Column | str, names: list[str]) -> Column:
    """A column of single CSV records as structs of strings, by the rules of ``read_source``."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return F.from_csv(record, schema, {"quote": '"', "escape": '"'})


def frame_source(spark: SparkSession, frame) -> DataFrame:
    """A Spark, pandas, Arrow or Polars frame, with upper-cased names."""
    if not isinstance(frame, DataFrame):
        frame = spark.createDataFrame(frame.to_arrow() if hasattr(frame, "to_arrow") else frame)
    return upper_names(frame)


def column_names(df: DataFrame) -> list[str]:
    return [c.upper() for c in df.columns]


def numbered(df: DataFrame, name: str = "DOC_ID") -> DataFrame:
    """Consecutive ids from 0 in the table's order, unless it has the column; files and partitions are counted, not gathered."""
    if name.upper() in (c.upper() for c in df.columns):
        return df
    part = df.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__mono"), *df.columns)
    # One row per partition, so the window over them is small.
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__offset"))
    within = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    return part.join(F.broadcast(offsets), "__part").select((F.col("__offset") + within).alias(name), *df.columns)


def json_keys(objects: Column | str, ordinal: Column | str, df: DataFrame) -> DataFrame:
    """(key, first): every key of flat JSON objects in a column, upper-cased, with the least ordinal that has it."""
    c = F.col(objects) if isinstance(objects, str) else objects
    o = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    keys = df.select(o.alias("first"), F.explode(F.json_object_keys(c)).alias("key"))
    return keys.groupBy(F.translate("key", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("key")).agg(F.min("first").alias("first"))


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes) of each file below a path; counts come from the footers."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))


def parquet_row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(row_group, rows, bytes) of one Parquet file, from its footer alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        groups = [(i, g.getRowCount(), g.getTotalByteSize()) for i, g in enumerate(reader.getRowGroups())]
    finally:
        reader.close()
    return spark.createDataFrame(groups, "row_group int, rows long, bytes long")


def row_at(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The row at a place of a Parquet table, whose files follow each other by path; only that row's file is read for it."""
    df = spark.read.parquet(path)
    sizes = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("file"))  # one row for each file
    found = sizes.select("file", (upto - F.col("n")).alias("before"), upto.alias("upto")).where((F.col("before") <= index) & (F.col("upto") > index)).first()
    here = (F.col("_metadata.file_path") == found.file) & (F.col("_metadata.row_index") == index - found.before) if found else F.lit(False)
    return df.where(here).select(*df.columns)


def to_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header that ``read_source`` takes; nested values as JSON."""
    nested = {n: F.to_json(n) for n, k in df.dtypes if k.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="")
