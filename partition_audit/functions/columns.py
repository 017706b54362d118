"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_null(columns: Sequence[str]) -> Column:
    """True when at least one of the columns is NULL, so the key cannot match anything."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality: NULL against a value differs, NULL against NULL does not."""
    return ~left.eqNullSafe(right)


def named(name: str) -> Column:
    """The column of that very name, dots and backticks in it included."""
    return F.col(f"`{name.replace('`', '``')}`")


def changed_list(columns: Sequence[str], left: str, right: str, names: Sequence[str] | None = None) -> Column:
    """Comma-joined `names` of the fields in which the structs `left` and `right` differ."""
    return F.concat_ws(
        ",",
        *[F.when(differs(F.col(left)[c], F.col(right)[c]), F.lit(n)) for c, n in zip(columns, names or columns)],
    )


def null_count(column: str) -> Column:
    return F.count(F.when(F.col(column).isNull(), 1))


def text_length(column: str) -> Column:
    """Characters (not bytes) of the value as text."""
    return F.length(F.col(column).cast("string")).cast("bigint")


def mock_value(field: T.StructField) -> Column:
    """Recognisable filler: 'mock_<name>' for text, -1 for numbers, NULL for other types."""
    if isinstance(field.dataType, T.StringType):
        value = F.lit(f"mock_{field.name}")
    elif isinstance(field.dataType, T.NumericType):
        value = F.lit(-1)
    else:
        value = F.lit(None)
    return value.cast(field.dataType).alias(field.name)


def human_bytes(size: Column) -> Column:
    """Byte count as text with a binary unit, one decimal place."""
    units = ["B", "K", "M", "G", "T", "P"]
    expr = F.format_string("%.1f P", size / F.lit(1024.0**5))
    for power in range(len(units) - 2, -1, -1):
        scaled = F.format_string(f"%.{1 if power else 0}f {units[power]}", size / F.lit(1024.0**power))
        expr = F.when(size < 1024 ** (power + 1), scaled).otherwise(expr)
    return expr


def metric_rows(
    one_row: DataFrame, labels: Sequence[str], rows: Sequence[tuple[Sequence[str], Column]], value: str
) -> DataFrame:
    """Turn a one-row aggregate into one row per metric, without a second aggregate per metric."""
    entries = [
        F.struct(
            *[F.lit(text).alias(label) for label, text in zip(labels, texts)],
            F.coalesce(amount, F.lit(0)).cast("bigint").alias(value),
        )
        for texts, amount in rows
    ]
    return one_row.select(F.inline(F.array(*entries)))
