"""Schema changes as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.operators.frames import PARTITION_COLUMN


def evolve_schema(
    df: DataFrame,
    add: Mapping[str, str] | None = None,
    rename: Mapping[str, str] | None = None,
    cast: Mapping[str, str] | None = None,
    partition_cols: Sequence[str] = (PARTITION_COLUMN,),
) -> DataFrame:
    """Rows under the new schema: `rename` old to new name, `cast` by old name, `add` as NULL.

    Added columns follow the existing ones but stay ahead of the partition columns.
    """
    add, rename, cast = dict(add or {}), dict(rename or {}), dict(cast or {})
    unknown = sorted((set(rename) | set(cast)) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    if fixed := sorted(set(partition_cols) & (set(rename) | set(cast))):
        raise ValueError(f"partition columns cannot be changed: {fixed}")
    kept, partitions = [], []
    for name in df.columns:
        column = F.col(name).cast(cast[name]) if name in cast else F.col(name)
        (partitions if name in partition_cols else kept).append(column.alias(rename.get(name, name)))
    added = [F.lit(None).cast(kind).alias(name) for name, kind in add.items()]
    result = df.select(*kept, *added, *partitions)
    if len(set(result.columns)) != len(result.columns):
        raise ValueError(f"column names clash: {result.columns}")
    return result
