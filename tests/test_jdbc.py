"""JDBC options and argument checks. No database is started, so no rows are moved here."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

import partition_audit as pa
from partition_audit.sources.jdbc import read_options, write_options

OPTS = {"url": "jdbc:none:nowhere", "user": "u"}
MYSQL = {"url": "jdbc:mysql://host/db"}
SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def test_read_options():
    assert read_options(OPTS, "t") == {**OPTS, "dbtable": "t", "fetchsize": "10000"}
    assert read_options(OPTS, " SELECT a\nFROM t; ")["dbtable"] == "(SELECT a\nFROM t) q"
    assert read_options({**OPTS, "fetchsize": "5"}, "t")["fetchsize"] == "5"
    split = read_options(OPTS, "t", "id", 0, 100, 4)
    wanted = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    assert {k: split[k] for k in wanted} == wanted
    with pytest.raises(ValueError, match="split read needs"):
        read_options(OPTS, "t", "id", num_partitions=4)
    with pytest.raises(ValueError, match="no table"):
        read_options(OPTS, " ; ")


def test_mysql_options():
    limited = read_options(MYSQL, "select * from t", limit="3")
    assert limited["dbtable"] == "(SELECT * FROM (select * from t) q LIMIT 3) q_limit"
    assert limited["useCursorFetch"] == "true"
    assert read_options(OPTS, "t", limit=3)["dbtable"] == "t"
    assert write_options(MYSQL, "t", 500, 8) == {
        **MYSQL, "rewriteBatchedStatements": "true", "dbtable": "t", "batchsize": "500", "numPartitions": "8",
    }
    assert "rewriteBatchedStatements" not in write_options(OPTS, "t")


def test_errors_are_raised(spark):
    with pytest.raises(Exception, match="No suitable driver"):
        pa.jdbc_read(spark, OPTS, "SELECT 1")
    with pytest.raises(Exception, match="No suitable driver"):
        pa.jdbc_insert_rows(spark, OPTS, "t", [{"id": 1}], SCHEMA)
    with pytest.raises(ValueError, match="unknown columns"):
        pa.jdbc_insert_rows(spark, OPTS, "t", [{"id": 1}, {"id": 2, "late": 3}], SCHEMA)


def test_no_rows_is_no_write(spark):
    assert pa.jdbc_insert_rows(spark, OPTS, "t", [], SCHEMA) == 0
