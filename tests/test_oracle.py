"""Every registered query against its SQL on DuckDB, value by value."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from partition_audit.plans.registry import QUERIES as LIBRARY

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in row)


def test_every_query_has_an_oracle():
    assert list(LIBRARY) and set(LIBRARY) <= set(ORACLE) <= set(QUERIES)


SPARK_TYPE = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
              "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_result(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLE[name])
    assert df.columns == expected.columns
    assert [t for _, t in df.dtypes] == [SPARK_TYPE[str(t)] for t in expected.types]
    got = sorted((plain(r) for r in df.collect()), key=repr)
    assert got == sorted((plain(r) for r in expected.fetchall()), key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() == 305
