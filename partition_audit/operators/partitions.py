"""A table's rows after a partition change. `sources.writers` applies the same changes to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partition_audit.operators.frames import PARTITION_COLUMN, other_partitions


def keep_clean(df: DataFrame, drop_predicate: Column) -> DataFrame:
    """Drop the rows for which the predicate is true; rows where it is NULL stay."""
    return df.where(~F.coalesce(drop_predicate, F.lit(False)))


def data_clean(
    df: DataFrame, ds: str, drop_predicate: Column, col: str = PARTITION_COLUMN
) -> DataFrame:
    return keep_clean(df, F.col(col).eqNullSafe(F.lit(ds)) & drop_predicate)


def move_partition(
    df: DataFrame, src_ds: str, dst_ds: str, drop_source: bool = False, col: str = PARTITION_COLUMN
) -> DataFrame:
    """The source partition's rows replace those of the destination; the source stays unless asked.

    One scan: source rows are emitted under both partition values instead of reading them twice.
    """
    if src_ds == dst_ds:
        raise ValueError("source and destination partition are the same")
    kept = other_partitions(df, dst_ds, col)
    targets = [dst_ds] if drop_source else [src_ds, dst_ds]
    values = F.when(
        F.col(col) == F.lit(src_ds), F.array(*[F.lit(value) for value in targets])
    ).otherwise(F.array(F.col(col)))
    placed = kept.withColumn("__ds", F.explode(values))
    return placed.select(*[F.col("__ds").alias(c) if c == col else F.col(c) for c in df.columns])


def drop_partition(df: DataFrame, ds: str, col: str = PARTITION_COLUMN) -> DataFrame:
    return other_partitions(df, ds, col)


def create_temp_partition(df: DataFrame, ds: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """Partition inventory with `ds` in it, at 0 rows unless it already held some."""
    counted = df.select(F.col(col), F.lit(1).cast("bigint").alias("n"))
    added = df.sparkSession.range(1).select(F.lit(ds).alias(col), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(added).groupBy(col).agg(F.sum("n").alias("row_count"))
