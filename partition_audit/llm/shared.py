"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# A batch goes a row beyond the limit; below a power of two, its buffer is not doubled for that.
BATCH_BYTES = 7 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Only where it is unset (local runs, tests) a folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a `written` table that nothing reads any more; for other DataFrames nothing happens."""
    path = getattr(table, "written_path", None)
    if path is not None:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches in its session held to BATCH_BYTES unless the session has its own limit.

    Spark counts rows alone by default: 10,000 long texts would fill a worker.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def give_back_memory() -> None:
    """Return what a batch's arrays have freed to the system: workers wait for further tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in all rows: what partition and bucket counts are sized by."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def some_text(column: str = "text"):
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores before it until no column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
