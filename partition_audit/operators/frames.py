"""Partition filters, partition lookup and compare-column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION_COLUMN = "ds"


def partition_filter(df: DataFrame, ds: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """Rows of one partition. On a partitioned table this prunes directories."""
    return df.where(F.col(col) == F.lit(ds))


def other_partitions(df: DataFrame, ds: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """Rows of every other partition, the NULL (default) partition included."""
    return df.where(~F.col(col).eqNullSafe(F.lit(ds)))


def with_day_partition(df: DataFrame, ts_col: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """Derive a text day partition value (yyyy-MM-dd) from a timestamp column."""
    return df.withColumn(col, F.col(ts_col).cast("date").cast("string")).drop(ts_col)


def day_slice(df: DataFrame, ts_col: str, ds: str, col: str = PARTITION_COLUMN) -> DataFrame:
    """One derived day partition, filtered by a timestamp range.

    Comparing the derived text would read every row group; the range on the raw column is pushed
    down to the file scan and lets it skip row groups by their statistics.
    """
    start = date.fromisoformat(ds)
    kind = df.schema[ts_col].dataType
    in_day = (F.col(ts_col) >= F.lit(start.isoformat()).cast(kind)) & (
        F.col(ts_col) < F.lit((start + timedelta(days=1)).isoformat()).cast(kind)
    )
    return df.where(in_day).drop(ts_col).withColumn(col, F.lit(ds))


def partition_inventory(df: DataFrame, col: str = PARTITION_COLUMN) -> DataFrame:
    """Row count per partition value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))


def resolve_partition(partitions: DataFrame, raw: str, col: str = PARTITION_COLUMN) -> str:
    """Find the stored partition value that a loosely written one stands for.

    An exact match wins. Otherwise separators and letter case are ignored ('20260308' finds
    '2026-03-08', but never '2026-03-08-temp'), as is a leading '<column>='. Only matching values
    reach the driver, three at most.
    """

    def squeeze(column):
        return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))

    wanted = raw.strip().removeprefix(f"{col}=")
    stored = F.col(col).cast("string")
    matches = (
        partitions.where(squeeze(stored) == squeeze(F.lit(wanted)))
        .select(stored.alias("value"))
        .distinct()
        .orderBy((F.col("value") == F.lit(wanted)).desc(), "value")
        .limit(3)
        .collect()
    )
    values = [row["value"] for row in matches]
    if not values:
        raise LookupError(f"no partition {col} matches {raw!r}")
    if values[0] == wanted or len(values) == 1:
        return values[0]
    raise LookupError(f"partition {raw!r} is ambiguous: {values}")


def compare_columns(
    src: DataFrame | T.StructType,
    tgt: DataFrame | T.StructType,
    exclude: Iterable[str] = (PARTITION_COLUMN,),
) -> list[str]:
    """Columns of both sides, in source order, without the partition column.

    Names are told apart as Spark does, without regard to case. A column that only one side has is an
    error: left out, rows that differ in it would count as the same.
    """
    skipped = {name.lower() for name in exclude}
    here, there = ({n.lower(): n for n in _names(side) if n.lower() not in skipped} for side in (src, tgt))
    if alone := sorted(here.keys() ^ there.keys()):
        raise ValueError(f"columns on one side only: {alone}; name the columns to compare")
    return list(here.values())


def check_same_types(src: DataFrame, tgt: DataFrame, columns: Sequence[str]) -> None:
    """Refuse to compare or merge columns whose types differ: a silent cast hides differences."""
    for name in columns:
        left, right = (d.schema[name].dataType.simpleString() for d in (src, tgt))
        if left != right:
            raise TypeError(f"column {name!r} is {left} on one side and {right} on the other")


_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def wider_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The narrowest type that holds every value of both without loss; None where there is none.

    Whole numbers widen to longer ones and to decimals, floats to doubles, decimals to decimals with room for both,
    text of a bounded length to text; arrays, maps and structs with the same field names by their parts. Exact
    numbers are not compared with binary fractions, numbers not with text, nor times of different kinds.
    """
    if left == right:
        return left
    kinds = (type(left), type(right))
    if all(k in _WHOLE for k in kinds):
        return max(left, right, key=lambda t: _WHOLE[type(t)])
    if all(isinstance(t, (T.StringType, T.CharType, T.VarcharType)) for t in (left, right)):
        return T.StringType()
    if set(kinds) == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if T.DecimalType in kinds and all(k in _WHOLE or k is T.DecimalType for k in kinds):
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_WHOLE[type(t)], 0) for t in (left, right)]
        whole, scale = (max(x) for x in zip(*parts))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if kinds == (T.ArrayType, T.ArrayType):
        item = wider_type(left.elementType, right.elementType)
        return item and T.ArrayType(item, left.containsNull or right.containsNull)
    if kinds == (T.MapType, T.MapType):
        key, value = wider_type(left.keyType, right.keyType), wider_type(left.valueType, right.valueType)
        return key and value and T.MapType(key, value, left.valueContainsNull or right.valueContainsNull)
    if kinds == (T.StructType, T.StructType) and left.fieldNames() == right.fieldNames():
        fields = [(a.name, wider_type(a.dataType, b.dataType), a.nullable or b.nullable) for a, b in zip(left, right)]
        return None if any(f[1] is None for f in fields) else T.StructType([T.StructField(*f) for f in fields])
    return None


def common_types(src: DataFrame, tgt: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """Per column the type both sides are compared in; refused where a value could be lost or hidden by a cast."""
    found = {}
    for name in columns:
        left, right = src.schema[name].dataType, tgt.schema[name].dataType
        found[name] = wider_type(left, right)
        if found[name] is None:
            raise TypeError(
                f"column {name!r} is {left.simpleString()} on one side and {right.simpleString()} on the other"
            )
    return found


def _names(side: DataFrame | T.StructType) -> list[str]:
    return side.fieldNames() if isinstance(side, T.StructType) else side.columns
