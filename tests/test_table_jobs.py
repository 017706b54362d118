"""The composite jobs on stored tables: a small four-column table checked alone and against itself."""

from __future__ import annotations

import pytest

import partition_audit as pa
from tests.conftest import DAY, rows_of

# The second sample table.
ROWS = [("1", "u1", 100, "ok", DAY), ("2", "u2", 50, "hold", DAY), ("3", "u3", None, "bad", DAY)]


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame(ROWS, "id string, user_id string, amount int, status string, ds string")
    frame.write.format("orc").partitionBy("ds").saveAsTable("small_table")
    return "small_table"


def test_diff_with_itself(spark, table):
    diff = pa.diff_tables(spark, table, table, ["id"], "20260308")
    assert rows_of(diff) == []
    assert "ds_src" not in diff.columns
    everything = pa.diff_tables(spark, table, table, ["id"], DAY, DAY, include_same=True)
    assert rows_of(everything.select("id", "diff_type")) == [(i, "same") for i in "123"]


def test_compare_with_itself(spark, table):
    got = dict(rows_of(pa.compare_tables(spark, table, table, ["id"], DAY)))
    assert got == {
        "source_count": 3, "target_count": 3, "source_duplicate_keys": 0, "target_duplicate_keys": 0,
        "only_source": 0, "only_target": 0, "extra_source": 0, "extra_target": 0, "changed": 0, "same": 3,
    }


def test_compare_two_partitions(spark, table):
    pa.copy_partition(spark, table, DAY, f"{DAY}-temp")
    pa.clean_partition(spark, table, f"{DAY}-temp", pa.read_table(spark, table)["status"] == "bad")
    got = dict(rows_of(pa.compare_tables(spark, table, table, ["id"], DAY, f"{DAY}-temp")))
    assert (got["only_source"], got["same"]) == (1, 2)
    pa.remove_partition(spark, table, f"{DAY}-temp")


def test_validate(spark, table):
    checks = pa.validate_table(spark, table, DAY, [["id"], ["status"]])
    assert [tuple(r) for r in checks.collect()] == [
        ("row_count", "*", 3),
        ("null_count", "id", 0),
        ("null_count", "user_id", 0),
        ("null_count", "amount", 1),
        ("null_count", "status", 0),
        ("duplicate_keys", "id", 0),
        ("duplicate_keys", "status", 0),
    ]


def test_unknown_partition(spark, table):
    with pytest.raises(LookupError):
        pa.validate_table(spark, table, "2020-01-01", [["id"]])
