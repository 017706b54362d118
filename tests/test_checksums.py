"""Comparison by checksums of key buckets: same counts as the comparison in full, little to shuffle."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from partition_audit.operators.compare import align, checked_tally, differing_buckets
from partition_audit.plans.jobs import data_compare
from tests.conftest import rows_of
from tests.test_plans import final_plan

ROWS = [(i % 40 if i % 11 else None, f"v{i % 7}" if i % 5 else None, float(i % 3) if i % 4 else None) for i in range(300)]
SCHEMA = "k int, a string, b double"


@pytest.mark.parametrize("buckets", [1, 3, 64, 4096])
@pytest.mark.parametrize(
    "change",
    [
        lambda rows: rows,
        lambda rows: rows[:-1],
        lambda rows: rows + rows[:2],
        lambda rows: [],
        lambda rows: [(k, "new" if k == 3 else a, b) for k, a, b in rows],
        lambda rows: [(k, a, b) for k, a, b in rows if k != 9] + [(99, "x", 0.0)],
    ],
)
def test_same_counts_as_in_full(spark, buckets, change):
    src, tgt = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(change(ROWS), SCHEMA)
    for left, right in ((src, tgt), (tgt, src)):
        assert rows_of(data_compare(left, right, ["k"], checksum_buckets=buckets)) == rows_of(data_compare(left, right, ["k"]))


@pytest.mark.parametrize(
    "left,right",
    [
        ([(1, "a", None), (2, "b", None)], [(1, "b", None), (2, "a", None)]),  # values of two keys swapped
        ([(1, None, 1.0)], [(1, "", 1.0)]),
        ([(1, "a", 1.0), (1, "a", 1.0)], [(1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0)]),
        ([(1, "a", 1.0), (1, "b", 2.0)], [(1, "a", 2.0), (1, "b", 1.0)]),
    ],
)
def test_sums_tell_rows_apart(spark, left, right):
    sides = align(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"])
    assert differing_buckets(sides, 1) == [0]


def test_nulls_change_places(spark):
    schema = "k int, a int, b int"
    sides = align(spark.createDataFrame([(1, None, 5)], schema), spark.createDataFrame([(1, 5, None)], schema), ["k"])
    assert differing_buckets(sides, 8)


def test_order_of_rows_does_not_matter(spark):
    sides = align(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(ROWS[::-1], SCHEMA), ["k"])
    assert differing_buckets(sides, 4096) == []


def test_rows_of_equal_buckets_stay_where_they_are(spark):
    src = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("a"))
    tgt = src.withColumn("a", F.when(F.col("k") == 7, "x").otherwise(F.col("a")))
    tally = checked_tally(align(src, tgt, ["k"]), 4096)
    text = final_plan(tally)
    # What is compared in full passes a filter of one bucket; the rest is grouped by key alone.
    assert len(re.findall(r"xxhash64", text)) > 0
    counts = [r.asDict() for r in tally.where("m < s or m < t").collect()]
    assert counts == [{"s": 1, "t": 1, "m": 0, "mp": 0}]
    assert "hashpartitioning(__k0#" in text
    assert len(differing_buckets(align(src, tgt, ["k"]), 4096)) == 1


def test_nested_values_are_compared_in_full(spark):
    schema = "k int, a array<int>"
    src, tgt = spark.createDataFrame([(1, [None, 1])], schema), spark.createDataFrame([(1, [1, None])], schema)
    counts = dict(rows_of(data_compare(src, tgt, ["k"], checksum_buckets=16)))
    assert counts["changed"] == 1 and counts["same"] == 0


def test_what_is_refused(spark):
    src = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        data_compare(src, src, ["k"], checksum_buckets=0)
    with pytest.raises(ValueError):
        data_compare(src, src, ["k"], pairing="sql", checksum_buckets=8)
