"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partition_audit.session import shuffle_width

# Spark's own limit on rank filters that reach the map side, unless the session lifts it.
DIRECT_LIMIT = 1_000


def group_top_n(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    n: int,
    *,
    tie_break: Sequence[str],
    salts: int | None = None,
) -> DataFrame:
    """First `n` rows per group by `order_cols`, then `tie_break`, with their rank in `rn`.

    Up to `DIRECT_LIMIT` rows a group, one shuffle does: Spark cuts every group to `n` rows per task before it.
    For a larger `n` a group is first cut to `n` rows in each of `salts` parts, so no task receives more than
    `salts * n` rows of a hot group. The result is the same; `salts` chooses the way for any `n`.
    """
    if "rn" in df.columns:
        raise ValueError("the input already has a column 'rn'")
    order = [*order_cols, *tie_break]
    if salts is None:
        salts = 1 if n <= DIRECT_LIMIT else shuffle_width(df.sparkSession)
    if salts > 1:
        # The part is the input task: it stays the same when a task is run again.
        salted = df.withColumn("__part", F.spark_partition_id() % F.lit(salts))
        df = _first_n(salted, [*partition_cols, "__part"], order, n).drop("__part", "rn")
    return _first_n(df, partition_cols, order, n).withColumn("rn", F.col("rn").cast("bigint"))


def _first_n(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)
