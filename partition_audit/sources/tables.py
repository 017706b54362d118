"""Reading partitioned tables by catalog name or by path."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partition_audit.operators.frames import PARTITION_COLUMN, partition_filter

DEFAULT_FORMAT = "orc"


def is_path(target: str) -> bool:
    return "/" in target


def read_table(
    spark: SparkSession,
    target: str,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A whole table. By path, the partition column is always text, whatever it looks like."""
    if not is_path(target):
        return spark.table(target)
    reader = spark.read.format(fmt)
    if schema is not None:
        return reader.schema(schema).load(target)
    df = reader.load(target)
    if col in df.columns and not isinstance(df.schema[col].dataType, T.StringType):
        text = T.StructType(
            [T.StructField(f.name, T.StringType()) if f.name == col else f for f in df.schema]
        )
        df = spark.read.format(fmt).schema(text).load(target)
    return df


def read_partition(
    spark: SparkSession,
    target: str,
    ds: str,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One partition; a missing one has no rows.

    From the catalog, other partitions are pruned before their files are listed. By path, only the
    partition's own directory is listed, not the whole table (unless its name has escaped characters).
    """
    if is_path(target) and is_safe(ds):
        fs, path = file_system(spark, table_path(spark, target, ds, col))
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        if any(not name.startswith(("_", ".")) for name in names):
            reader = spark.read.format(fmt)
            if schema is not None:
                reader = reader.schema(T.StructType([f for f in schema if f.name != col]))
            return reader.load(str(path)).withColumn(col, F.lit(ds))
    return partition_filter(read_table(spark, target, fmt, col, schema), ds, col)


def partition_values(spark: SparkSession, target: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """Known partition values, empty partitions included. No data file is opened for it."""
    if not is_path(target):
        spec = F.regexp_extract("partition", f"(?:^|/){re.escape(col)}=([^/]*)", 1)
        # Names come escaped as in directory names, where '+' stands for itself.
        value = F.coalesce(F.try_url_decode(F.replace(spec, F.lit("+"), F.lit("%2B"))), spec)
        return spark.sql(f"SHOW PARTITIONS {target}").select(value.alias(col))
    fs, path = file_system(spark, target)
    names = [str(status.getPath().getName()) for status in fs.listStatus(path)]
    values = [(unquote(n.split("=", 1)[1]),) for n in names if n.startswith(f"{col}=")]
    return spark.createDataFrame(values, T.StructType([T.StructField(col, T.StringType())]))


def table_path(spark: SparkSession, target: str, ds: str | None = None, col: str = PARTITION_COLUMN) -> str:
    """Storage location of a table or of one of its partitions."""
    if is_path(target):
        return target if ds is None else f"{target.rstrip('/')}/{col}={safe_value(ds)}"
    part = "" if ds is None else f" PARTITION ({col}='{safe_value(ds)}')"
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {target}{part}").where("col_name = 'Location'").collect()
    # A partition description holds its own location first, then the table's.
    return rows[0]["data_type"]


def is_safe(ds: str) -> bool:
    """Whether a partition value can stand in DDL and directory names as it is."""
    return re.fullmatch(r"[\w.+ -]+", ds) is not None


def safe_value(ds: str) -> str:
    if not is_safe(ds):
        raise ValueError(f"unsupported characters in partition value {ds!r}")
    return ds


def file_system(spark: SparkSession, location: str):
    """Hadoop file system and path object, for what has no DataFrame counterpart."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
