"""Merging tables and adding literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from partition_audit.functions import mock_value
from partition_audit.operators.frames import check_same_types


def union_merge(frames: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    """All rows of all frames, duplicates kept. Column types have to agree."""
    if not frames:
        raise ValueError("nothing to merge")
    first = frames[0]
    aligned = [first]
    for df in frames[1:]:
        if not by_name:
            if len(df.columns) != len(first.columns):
                raise ValueError(f"cannot merge {len(df.columns)} columns into {len(first.columns)}")
            df = df.toDF(*first.columns)
        elif set(df.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(first.columns))}")
        check_same_types(first, df, first.columns)
        aligned.append(df)
    return reduce(DataFrame.unionByName, aligned)


def literal_rows(
    spark: SparkSession, schema: T.StructType, rows: Sequence[Mapping | Sequence]
) -> DataFrame:
    """A frame of given rows. Mappings may leave columns out (NULL) but not name unknown ones."""
    names = schema.fieldNames()
    values = []
    for row in rows:
        if isinstance(row, Mapping):
            unknown = sorted(set(row) - set(names))
            if unknown:
                raise ValueError(f"unknown columns: {unknown}")
            row = [row.get(name) for name in names]
        values.append(tuple(row))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.createDataFrame(values, nullable)


def mock_rows(spark: SparkSession, schema: T.StructType, n: int = 1) -> DataFrame:
    return spark.range(n).select(*[mock_value(field) for field in schema])


def insert_values(df: DataFrame, rows: DataFrame | Sequence[Mapping | Sequence]) -> DataFrame:
    """The table's rows after the insert."""
    if not isinstance(rows, DataFrame):
        rows = literal_rows(df.sparkSession, df.schema, rows)
    return union_merge([df, rows])
