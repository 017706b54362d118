"""Storage size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partition_audit.functions import human_bytes
from partition_audit.operators.frames import PARTITION_COLUMN
from partition_audit.sources.tables import table_path


def partition_size(
    spark: SparkSession,
    path: str,
    group: str = rf"/{PARTITION_COLUMN}=([^/]+)/",
    group_name: str = PARTITION_COLUMN,
    human: bool = False,
) -> DataFrame:
    """Files and bytes below `path`, grouped by the first capture of the regular expression `group`.

    Only file lengths are read, never contents. Hidden files and replicas do not count.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ).select(F.regexp_extract("path", group, 1).alias(group_name), "length")
    sizes = files.groupBy(group_name).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes")
    )
    return sizes.withColumn("size", human_bytes(F.col("total_bytes"))) if human else sizes


def table_size(
    spark: SparkSession, target: str, ds: str | None = None, col: str = PARTITION_COLUMN, human: bool = False
) -> DataFrame:
    """Size per partition of a table (catalog name or path), or of one partition only."""
    return partition_size(
        spark, table_path(spark, target, ds, col), rf"/{col}=([^/]+)/", col, human
    )
