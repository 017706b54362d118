"""Relational databases over JDBC: partitioned reads and batched appends.

Connection options (`url`, `user`, `password`, `driver`, ...) come from the caller's secret store.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from partition_audit.operators.combine import literal_rows

LOGGER = logging.getLogger(__name__)

FETCH_ROWS = 10_000
BATCH_ROWS = 1_000

# MySQL driver properties. Without the first the driver ignores the fetch size and
# buffers the whole result; the second turns a batch into multi-row INSERT statements.
MYSQL_URLS = ("jdbc:mysql:", "jdbc:mariadb:")
MYSQL_READ = {"useCursorFetch": "true"}
MYSQL_WRITE = {"rewriteBatchedStatements": "true"}


def is_mysql(opts: Mapping[str, str]) -> bool:
    return opts.get("url", "").startswith(MYSQL_URLS)


def read_options(
    opts: Mapping[str, str],
    table_or_query: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    num_partitions: int | None = None,
    limit: int | str | None = None,
) -> dict[str, str]:
    """Reader options. A SELECT is wrapped so that it can be split like a table.

    MySQL gets the row limit in the statement, so that it does not send more; not in a split read,
    where each task would cut a result of its own.
    """
    text = table_or_query.strip().rstrip(";")
    if not text:
        raise ValueError("no table or query given")
    is_query = re.match(r"(?is)(\s|\(|--[^\n]*\n|/\*.*?\*/)*(select|with)\b", text) is not None
    source = f"({text}) q" if is_query else text
    if limit not in (None, "") and is_mysql(opts) and partition_column is None:
        source = f"(SELECT * FROM {source} LIMIT {int(limit)}) q_limit"
    bounds = {
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": num_partitions,
    }
    given = {name: str(value) for name, value in bounds.items() if value is not None}
    if given and len(given) != len(bounds):
        raise ValueError(f"a split read needs all of {sorted(bounds)}")
    defaults = {"fetchsize": str(FETCH_ROWS), **(MYSQL_READ if is_mysql(opts) else {})}
    return {**defaults, **opts, "dbtable": source, **given}


def write_options(
    opts: Mapping[str, str], table: str, batchsize: int = BATCH_ROWS, connections: int | None = None
) -> dict[str, str]:
    limits = {} if connections is None else {"numPartitions": str(connections)}
    defaults = MYSQL_WRITE if is_mysql(opts) else {}
    return {**defaults, **opts, "dbtable": table, "batchsize": str(batchsize), **limits}


def jdbc_read(
    spark: SparkSession,
    opts: Mapping[str, str],
    table_or_query: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    num_partitions: int | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """A table or a query's result; errors are raised, never turned into an empty result.

    With a partition column and bounds, `num_partitions` tasks read ranges of it side by side. The
    bounds only set the range widths: rows outside them are read too.
    """
    options = read_options(
        opts, table_or_query, partition_column, lower, upper, num_partitions, limit
    )
    df = spark.read.format("jdbc").options(**options).load()
    return df if limit in (None, "") else df.limit(int(limit))


def jdbc_append(
    df: DataFrame,
    opts: Mapping[str, str],
    table: str,
    batchsize: int = BATCH_ROWS,
    connections: int | None = None,
) -> None:
    """Append rows with bound parameters, `batchsize` rows per round trip.

    Spark commits once per partition. Where all or nothing is needed, append to a staging table and
    publish from it in the database. `connections` bounds how many partitions write at once.
    """
    options = write_options(opts, table, batchsize, connections)
    df.write.format("jdbc").options(**options).mode("append").save()


def jdbc_insert_rows(
    spark: SparkSession,
    opts: Mapping[str, str],
    table: str,
    rows: Sequence[Mapping],
    schema: T.StructType,
    batchsize: int = BATCH_ROWS,
) -> int:
    """Append literal rows under a declared schema; returns how many. No rows: nothing happens.

    A column missing from a row is NULL, an unknown one is an error.
    """
    if not rows:
        LOGGER.warning("no rows to insert into %s", table)
        return 0
    jdbc_append(literal_rows(spark, schema, rows), opts, table, batchsize)
    return len(rows)
