"""Applying partition changes to stored tables, named in the catalog or given by path.

Partitions are replaced in dynamic overwrite mode: tasks write aside, and the old files go only when
the whole job commits. A job that dies or loses executors leaves the old partition as it was, and a
partition may be rewritten from its own rows. Dynamic mode leaves a partition alone when no row is
left for it, so an empty result empties the partition in a second, static step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from partition_audit.operators.combine import literal_rows
from partition_audit.operators.evolve import evolve_schema
from partition_audit.operators.frames import PARTITION_COLUMN
from partition_audit.operators.partitions import keep_clean
from partition_audit.sources.tables import (
    DEFAULT_FORMAT,
    file_system,
    is_path,
    partition_values,
    read_partition,
    read_table,
    safe_value,
    table_path,
)

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
ASIDE = "__replaced"


def overwrite_partition(
    df: DataFrame,
    target: str,
    ds: str,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
    compact: bool = False,
) -> None:
    """Make `df` (with or without its partition column) the content of one partition.

    `compact` adds a shuffle that evens out file sizes, for inputs of many small tasks.
    """
    spark = df.sparkSession
    safe_value(ds)
    seen = Observation()
    rows = df.drop(col).observe(seen, F.count(F.lit(1)).alias("rows"))
    if compact:
        rows = rows.hint("rebalance")
    rows = rows.withColumn(col, F.lit(ds))
    if is_path(target):
        writer = rows.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(col).save(target)
        spark.catalog.refreshByPath(target)
    else:
        aligned = _in_table_order(rows, target)
        with _dynamic_overwrite(spark):
            aligned.write.mode("overwrite").insertInto(target)
    if seen.get["rows"] == 0:
        _empty_partition(df.drop(col), target, ds, fmt, col)


def clean_partition(
    spark: SparkSession,
    target: str,
    ds: str,
    drop_predicate: Column,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> None:
    """Rewrite one partition without the rows for which the predicate is true.

    Without such a row nothing is written. The check reads only the predicate's columns and stops at
    the first hit.
    """
    rows = read_partition(spark, target, ds, fmt, col)
    if rows.where(drop_predicate).isEmpty():
        return
    overwrite_partition(keep_clean(rows, drop_predicate), target, ds, fmt, col)


def copy_partition(
    spark: SparkSession,
    target: str,
    src_ds: str,
    dst_ds: str,
    drop_source: bool = False,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> None:
    """Replace the destination's content by the source's.

    With `drop_source` the partition is renamed: no row is read or written. The destination's old
    content is renamed aside first and deleted last, so that both partitions can be had back whatever
    step fails: an error puts the old content back at once, and after a crash the next move to the
    same destination, or `recover_partition`, does. Without `drop_source`, rows are copied. A source partition that does not exist is an error; an existing empty one empties the
    destination.
    """
    if src_ds == dst_ds:
        raise ValueError("source and destination partition are the same")
    if not _has_partition(spark, target, src_ds, col):
        raise LookupError(f"{target} has no partition {col}={src_ds}")
    if drop_source:
        recover_partition(spark, target, dst_ds, col)
        replaced = _has_partition(spark, target, dst_ds, col)
        if replaced:
            _rename_partition(spark, target, dst_ds, _aside(dst_ds), col)
        try:
            _rename_partition(spark, target, src_ds, dst_ds, col)
        except Exception:
            if replaced:
                _rename_partition(spark, target, _aside(dst_ds), dst_ds, col)
            raise
        if replaced:
            remove_partition(spark, target, _aside(dst_ds), col)
        return
    overwrite_partition(read_partition(spark, target, src_ds, fmt, col), target, dst_ds, fmt, col)


def recover_partition(spark: SparkSession, target: str, ds: str, col: str = PARTITION_COLUMN) -> bool:
    """Finish or undo a move to `ds` that a crash cut off; False where there is nothing to do.

    If the destination is there, the move had happened and what it replaced is deleted. If not, the
    replaced content comes back; the move's source was not touched yet.
    """
    if not _has_partition(spark, target, _aside(ds), col):
        return False
    if _has_partition(spark, target, ds, col):
        remove_partition(spark, target, _aside(ds), col)
    else:
        _rename_partition(spark, target, _aside(ds), ds, col)
    return True


def remove_partition(spark: SparkSession, target: str, ds: str, col: str = PARTITION_COLUMN) -> None:
    """Drop a partition; dropping a missing one does nothing."""
    value = safe_value(ds)
    if not is_path(target):
        spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({col}='{value}')")
        return
    fs, path = file_system(spark, table_path(spark, target, value, col))
    fs.delete(path, True)
    spark.catalog.refreshByPath(target)


def add_partition(
    spark: SparkSession,
    target: str,
    ds: str,
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> None:
    """Create an empty partition; an existing one keeps its rows."""
    value = safe_value(ds)
    if not is_path(target):
        spark.sql(f"ALTER TABLE {target} ADD IF NOT EXISTS PARTITION ({col}='{value}')")
        return
    fs, path = file_system(spark, table_path(spark, target, value, col))
    if not fs.exists(path):
        _empty_partition(read_table(spark, target, fmt, col).drop(col), target, value, fmt, col)


def append_rows(
    spark: SparkSession,
    target: str,
    ds: str,
    rows: DataFrame | Sequence[Mapping | Sequence],
    fmt: str = DEFAULT_FORMAT,
    col: str = PARTITION_COLUMN,
) -> None:
    """Add rows to one partition. Given as literals, columns left out of a mapping are NULL."""
    value = safe_value(ds)
    if not isinstance(rows, DataFrame):
        schema = read_table(spark, target, fmt, col).drop(col).schema
        rows = literal_rows(spark, schema, rows)
    rows = rows.drop(col).withColumn(col, F.lit(value))
    if is_path(target):
        rows.write.format(fmt).mode("append").partitionBy(col).save(target)
        spark.catalog.refreshByPath(target)
    else:
        _in_table_order(rows, target).write.insertInto(target)


def change_schema(
    spark: SparkSession,
    target: str,
    add: Mapping[str, str] | None = None,
    rename: Mapping[str, str] | None = None,
    cast: Mapping[str, str] | None = None,
    col: str = PARTITION_COLUMN,
) -> None:
    """Change a catalog table's columns.

    Added columns are a metadata change. A rename or a new type needs the rows rewritten: they go to
    a sibling table, which takes over the name once it is complete. The rewrite keeps the input's
    layout and has no shuffle. The old table stays as `<name>__before` until the new one is found to
    hold as many rows under its final name. If the new table cannot take the name, the old one gets
    it back. Table properties and comments are not carried over.
    """
    if is_path(target):
        raise ValueError("schema changes by path: write evolve_schema(...) to a new path")
    current = spark.table(target)
    evolved = evolve_schema(current, add, rename, cast, (col,))
    if not (add or rename or cast):
        return
    if not rename and not cast:
        columns = ", ".join(f"`{name}` {kind}" for name, kind in (add or {}).items())
        spark.sql(f"ALTER TABLE {target} ADD COLUMNS ({columns})")
        return
    fresh, before = f"{target}__after", f"{target}__before"
    writer = evolved.write.format(_provider(spark, target))
    if col in evolved.columns:
        writer = writer.partitionBy(col)
    writer.mode("errorifexists").saveAsTable(fresh)
    spark.sql(f"ALTER TABLE {target} RENAME TO {before}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {target}")
    except Exception:
        spark.sql(f"ALTER TABLE {before} RENAME TO {target}")
        if col in evolved.columns:
            spark.sql(f"MSCK REPAIR TABLE {target} SYNC PARTITIONS")
        spark.catalog.refreshTable(target)
        spark.sql(f"DROP TABLE {fresh}")
        raise
    for table in (target, before):
        if col in evolved.columns:
            # Not every catalog moves the partitions' locations along with the table's name.
            spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
        spark.catalog.refreshTable(table)
    kept, expected = (spark.table(table).count() for table in (target, before))
    if kept != expected:
        raise RuntimeError(f"{target} holds {kept} rows, {before} {expected}; {before} was kept")
    spark.sql(f"DROP TABLE {before}")


def _aside(ds: str) -> str:
    """Partition value under which replaced content waits for its deletion."""
    return f"{ds}{ASIDE}"


def _has_partition(spark: SparkSession, target: str, ds: str, col: str) -> bool:
    return not partition_values(spark, target, col).where(F.col(col) == ds).isEmpty()


def _rename_partition(spark: SparkSession, target: str, old: str, new: str, col: str) -> None:
    old, new = safe_value(old), safe_value(new)
    if not is_path(target):
        spark.sql(
            f"ALTER TABLE {target} PARTITION ({col}='{old}') RENAME TO PARTITION ({col}='{new}')"
        )
        return
    fs, path = file_system(spark, table_path(spark, target, old, col))
    if not fs.rename(path, file_system(spark, table_path(spark, target, new, col))[1]):
        raise OSError(f"could not rename {col}={old} to {col}={new} in {target}")
    spark.catalog.refreshByPath(target)


def _empty_partition(like: DataFrame, target: str, ds: str, fmt: str, col: str) -> None:
    spark = like.sparkSession
    none = spark.createDataFrame([], like.schema)
    if is_path(target):
        none.write.format(fmt).mode("overwrite").save(table_path(spark, target, ds, col))
        spark.catalog.refreshByPath(target)
        return
    columns = ", ".join(f"`{c}`" for c in spark.table(target).columns if c != col)
    spark.sql(
        f"INSERT OVERWRITE TABLE {target} PARTITION ({col}='{safe_value(ds)}') "
        f"SELECT {columns} FROM {{none}}",
        none=none,
    )


def _in_table_order(rows: DataFrame, target: str) -> DataFrame:
    """insertInto goes by position; put the columns in the table's order, by name."""
    columns = rows.sparkSession.table(target).columns
    if set(columns) != set(rows.columns):
        raise ValueError(f"columns differ from {target}: {sorted(set(columns) ^ set(rows.columns))}")
    return rows.select(*columns)


def _provider(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Provider'").collect()
    return rows[0]["data_type"]


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Dynamic overwrite mode for the session while at least one overwrite runs.

    The mode is looked up again while a job starts. Were it restored under another thread's
    overwrite, that one would replace the whole table, so only the last one out restores it.
    """
    with _mode_lock:
        running, before = _mode_users.get(spark) or (0, spark.conf.get(OVERWRITE_MODE))
        _mode_users[spark] = (running + 1, before)
        spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        with _mode_lock:
            running, before = _mode_users.pop(spark)
            if running > 1:
                _mode_users[spark] = (running - 1, before)
            else:
                spark.conf.set(OVERWRITE_MODE, before)


_mode_lock = Lock()
_mode_users: dict[SparkSession, tuple[int, str]] = {}
