"""Composite jobs: reconciliation of two tables and quality check of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partition_audit.functions import metric_rows, null_count
from partition_audit.operators.compare import align, checked_tally, data_diff, diff_totals, key_tally
from partition_audit.operators.frames import PARTITION_COLUMN, resolve_partition
from partition_audit.sources.tables import DEFAULT_FORMAT, partition_values, read_partition


def data_compare(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    pairing: str = "one_to_one",
    checksum_buckets: int | None = None,
) -> DataFrame:
    """Counts, repeated keys and diff classes of both sides, one row per metric.

    Every metric comes out of the same per-key tally: each table is read once. For tables that should be equal but
    for a few rows, `checksum_buckets` (65,536 at most) reads them twice instead: a first pass compares checksums
    per bucket of keys, and of buckets that do not differ no row is shuffled, only the source's keys.
    """
    if checksum_buckets is not None and pairing != "one_to_one":
        raise ValueError("checksums go with one-to-one pairing only")
    sides = align(src, tgt, keys, compare, pairing)
    tally = key_tally(sides) if checksum_buckets is None else checked_tally(sides, checksum_buckets)
    totals = tally.agg(
        F.sum("s").alias("source_count"),
        F.sum("t").alias("target_count"),
        F.count(F.when(F.col("s") > 1, 1)).alias("source_duplicate_keys"),
        F.count(F.when(F.col("t") > 1, 1)).alias("target_duplicate_keys"),
        *diff_totals(pairing),
    )
    metrics = [
        "source_count",
        "target_count",
        "source_duplicate_keys",
        "target_duplicate_keys",
        "only_source",
        "only_target",
        *(["extra_source", "extra_target"] if pairing == "one_to_one" else []),
        "changed",
        "same",
    ]
    return metric_rows(totals, ["metric"], [((m,), F.col(m)) for m in metrics], "value")


def data_validation(
    df: DataFrame, null_columns: Sequence[str], key_sets: Sequence[Sequence[str]]
) -> DataFrame:
    """Row count, NULL count per column and repeated values per key set, one row per check.

    All key sets are grouped in one pass (grouping sets), so the input is computed once; the row and
    NULL counts ride along with the first set.
    """
    sets = [list(dict.fromkeys(keys)) for keys in key_sets]
    if len({frozenset(s) for s in sets}) != len(sets) or not all(sets):
        raise ValueError("key sets must be non-empty and different")
    names = list(dict.fromkeys(name for keys in sets for name in keys))
    # Only whether values are equal or NULL matters: text travels as a digest.
    df = df.select(
        *[F.sha2(n, 256).alias(n) if df.schema[n].dataType == T.StringType() else F.col(n) for n in names],
        *[F.when(F.col(c).isNotNull(), 1).alias(c) for c in dict.fromkeys(null_columns) if c not in names],
    )
    nulls = [null_count(c).alias(f"nulls{i}") for i, c in enumerate(null_columns)]
    if not sets:
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *nulls)
        duplicates = []
    else:
        codes = [sum(2**i for i, n in enumerate(reversed(names)) if n not in keys) for keys in sets]
        grouped = df.groupingSets(sets, *names).agg(
            F.grouping_id().alias("set_code"), F.count(F.lit(1)).alias("rows"), *nulls
        )
        head = F.col("set_code") == codes[0]
        counts = grouped.agg(
            *[
                F.sum(F.when(head, F.col(c))).alias(c)
                for c in ["rows", *[f"nulls{i}" for i in range(len(null_columns))]]
            ],
            *[
                F.count(F.when((F.col("set_code") == code) & (F.col("rows") > 1), 1)).alias(f"repeated{i}")
                for i, code in enumerate(codes)
            ],
        )
        duplicates = [
            (("duplicate_keys", ",".join(keys)), F.col(f"repeated{i}")) for i, keys in enumerate(sets)
        ]
    checks = [
        (("row_count", "*"), F.col("rows")),
        *[(("null_count", c), F.col(f"nulls{i}")) for i, c in enumerate(null_columns)],
        *duplicates,
    ]
    return metric_rows(counts, ["check_name", "column_name"], checks, "value")


def open_partition(
    spark: SparkSession,
    target: str,
    raw: str,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> DataFrame:
    """One partition of a stored table, its value checked against those the table has."""
    value = resolve_partition(partition_values(spark, target, col), raw, col)
    return read_partition(spark, target, value, fmt, col)


def diff_tables(
    spark: SparkSession,
    source_table: str,
    target_table: str,
    join_keys: Sequence[str],
    source_partition: str,
    target_partition: str | None = None,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
    **options,
) -> DataFrame:
    """`data_diff` of two stored partitions; `options` are those of `data_diff`."""
    src = open_partition(spark, source_table, source_partition, fmt, col)
    tgt = open_partition(spark, target_table, target_partition or source_partition, fmt, col)
    return data_diff(src.drop(col), tgt.drop(col), join_keys, **options)


def compare_tables(
    spark: SparkSession,
    source_table: str,
    target_table: str,
    join_keys: Sequence[str],
    source_partition: str,
    target_partition: str | None = None,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
    **options,
) -> DataFrame:
    """`data_compare` of two stored partitions; `options` are those of `data_compare`."""
    src = open_partition(spark, source_table, source_partition, fmt, col)
    tgt = open_partition(spark, target_table, target_partition or source_partition, fmt, col)
    return data_compare(src.drop(col), tgt.drop(col), join_keys, **options)


def validate_table(
    spark: SparkSession,
    table: str,
    partition: str,
    key_sets: Sequence[Sequence[str]],
    null_columns: Sequence[str] | None = None,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> DataFrame:
    """`data_validation` of one stored partition, NULLs counted in all data columns by default."""
    rows = open_partition(spark, table, partition, fmt, col).drop(col)
    return data_validation(rows, rows.columns if null_columns is None else null_columns, key_sets)
