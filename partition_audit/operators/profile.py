"""Counts, distributions, NULL checks, repeated values and longest values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.functions import null_count, text_length


def data_num(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def batch_data_num(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named table. Each branch reads no data column."""
    if not frames:
        raise ValueError("no tables to count")
    counted = [
        df.agg(F.count(F.lit(1)).alias("total_count")).select(
            F.lit(name).alias("table_name"), "total_count"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionAll, counted)


def field_dist(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value distribution, most frequent first; NULL is a value of its own."""
    return _counted(df, cols).orderBy(F.desc("cnt"), *cols)


def null_checks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[null_count(c).alias(f"{c}_null_count") for c in cols])


def null_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL share per column, 0..1; NULL for an empty input."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_count"),
        *[(null_count(c) / F.nullif(total, F.lit(0))).alias(f"{c}_null_rate") for c in cols],
    )


def repeat_check(df: DataFrame, cols: Sequence[str], min_count: int = 2) -> DataFrame:
    """Values (NULL included) that occur at least `min_count` times.

    The count is combined on the map side, so a value held by a third of all rows reaches its
    reducer as one partial count per input task.
    """
    return _counted(df, cols).where(F.col("cnt") >= min_count)


def check_field_len(
    df: DataFrame, col: str, n: int = 5, *, tie_break: Sequence[str]
) -> DataFrame:
    """The `n` longest values of a column; `tie_break` names the row and settles equal lengths."""
    return (
        df.select(*tie_break, text_length(col).alias("field_len"))
        .orderBy(F.desc_nulls_last("field_len"), *tie_break)
        .limit(n)
    )


def _counted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))
