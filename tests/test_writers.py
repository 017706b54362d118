"""Partition changes applied to stored tables, by catalog name and by path."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import partition_audit as pa
from partition_audit.sources import writers
from tests.conftest import COLUMNS, DAY, rows_of

TEMP = f"{DAY}-temp"
OTHER = "2026-03-09"
numbers = itertools.count()


@pytest.fixture(params=["orc table", "parquet table", "orc path", "parquet path"])
def stored(request, spark, sample, tmp_path):
    """A two-partition table holding the source rows, as (target, format)."""
    fmt, kind = request.param.split()
    rows = pa.union_merge([sample["src"], sample["aux"].withColumn("ds", F.lit(OTHER))])
    if kind == "path":
        target = str(tmp_path / "t")
        rows.write.format(fmt).partitionBy("ds").save(target)
    else:
        target = f"t{next(numbers)}"
        rows.write.format(fmt).partitionBy("ds").saveAsTable(target)
    return target, fmt


def counts(spark, stored):
    return dict(rows_of(pa.partition_inventory(pa.read_table(spark, *stored))))


def test_partition_values_stay_text(spark, stored):
    df = pa.read_partition(spark, stored[0], DAY, stored[1])
    assert dict(df.dtypes)["ds"] == "string" and df.count() == 3
    assert set(df.columns) == {*COLUMNS, "ds"}


def test_only_one_partition_is_read(spark, stored):
    df = pa.read_partition(spark, stored[0], DAY, stored[1])
    files = df.inputFiles()
    assert files and all(f"/ds={DAY}/" in name for name in files)
    assert pa.read_partition(spark, stored[0], "2020-01-01", stored[1]).collect() == []
    if "/" in stored[0]:
        given = pa.read_partition(spark, stored[0], DAY, stored[1], schema=df.schema)
        assert rows_of(given) == rows_of(df)


def test_type_inference_does_not_matter(spark, stored):
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    spark.conf.set(key, "true")
    try:
        df = pa.read_partition(spark, stored[0], DAY, stored[1])
        assert dict(df.dtypes)["ds"] == "string" and df.count() == 3
    finally:
        spark.conf.set(key, "false")


def test_clean(spark, stored):
    pa.clean_partition(spark, stored[0], DAY, F.col("status") == "deleted", stored[1])
    left = pa.read_partition(spark, stored[0], DAY, stored[1])
    assert sorted(r.id for r in left.collect()) == ["1", "2"]
    assert counts(spark, stored) == {DAY: 2, OTHER: 2}


def test_clean_without_a_hit_writes_nothing(spark, stored):
    before = pa.read_partition(spark, stored[0], DAY, stored[1]).inputFiles()
    for predicate in (F.col("status") == "nowhere", F.lit(None).cast("boolean")):
        pa.clean_partition(spark, stored[0], DAY, predicate, stored[1])
    assert pa.read_partition(spark, stored[0], DAY, stored[1]).inputFiles() == before


def test_clean_that_removes_everything(spark, stored):
    pa.clean_partition(spark, stored[0], DAY, F.col("id").isNotNull(), stored[1])
    assert counts(spark, stored) == {OTHER: 2}
    pa.clean_partition(spark, stored[0], DAY, F.col("id").isNotNull(), stored[1])
    assert counts(spark, stored) == {OTHER: 2}


def test_copy_and_move(spark, stored):
    pa.copy_partition(spark, stored[0], DAY, TEMP, fmt=stored[1])
    assert counts(spark, stored) == {DAY: 3, TEMP: 3, OTHER: 2}
    pa.copy_partition(spark, stored[0], OTHER, TEMP, drop_source=True, fmt=stored[1])
    assert counts(spark, stored) == {DAY: 3, TEMP: 2}
    moved = pa.read_partition(spark, stored[0], TEMP, stored[1])
    assert sorted(r.id for r in moved.collect()) == ["8", "9"]
    pa.append_rows(spark, stored[0], TEMP, [{"id": "10"}], stored[1])
    assert counts(spark, stored) == {DAY: 3, TEMP: 3}


def test_move_renames_files(spark, stored):
    before = pa.read_partition(spark, stored[0], DAY, stored[1]).inputFiles()
    pa.copy_partition(spark, stored[0], DAY, "2026-03-10", drop_source=True, fmt=stored[1])
    after = pa.read_partition(spark, stored[0], "2026-03-10", stored[1]).inputFiles()
    assert sorted(after) == sorted(name.replace(DAY, "2026-03-10") for name in before)
    assert sorted(r.ds for r in pa.partition_values(spark, stored[0]).collect()) == [OTHER, "2026-03-10"]


@pytest.mark.parametrize("step", [1, 2, 3])
@pytest.mark.parametrize("crash", [False, True])
def test_move_that_fails_loses_nothing(spark, stored, monkeypatch, step, crash):
    """An error at any step, or a process that dies there: no rename or deletion runs after it."""
    target, fmt = stored
    done = []

    def failing(act):
        def run(*args):
            done.append(act)
            if len(done) == step or (crash and len(done) > step):
                raise OSError("no storage")
            return act(*args)

        return run

    with monkeypatch.context() as broken:
        for name in ("_rename_partition", "remove_partition"):
            broken.setattr(writers, name, failing(getattr(writers, name)))
        with pytest.raises(OSError):
            pa.copy_partition(spark, target, OTHER, DAY, drop_source=True, fmt=fmt)
    held = counts(spark, stored)
    assert sorted(held.values()) == ([2, 3])
    moved = step == 3
    assert pa.recover_partition(spark, target, DAY) == (moved or (crash and step == 2))
    assert not pa.recover_partition(spark, target, DAY)
    assert counts(spark, stored) == ({DAY: 2} if moved else {DAY: 3, OTHER: 2})
    if not moved:
        pa.copy_partition(spark, target, OTHER, DAY, drop_source=True, fmt=fmt)
        assert counts(spark, stored) == {DAY: 2}


@pytest.mark.parametrize("drop_source", [True, False])
def test_copy_of_a_missing_partition_is_refused(spark, stored, drop_source):
    before = counts(spark, stored)
    with pytest.raises(LookupError):
        pa.copy_partition(spark, stored[0], "2020-01-01", OTHER, drop_source=drop_source, fmt=stored[1])
    assert counts(spark, stored) == before


def test_copy_of_an_empty_partition_empties_the_destination(spark, stored):
    pa.add_partition(spark, stored[0], TEMP, stored[1])
    pa.copy_partition(spark, stored[0], TEMP, OTHER, fmt=stored[1])
    assert counts(spark, stored) == {DAY: 3}


def test_drop(spark, stored):
    pa.remove_partition(spark, stored[0], "2020-01-01")
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}
    pa.remove_partition(spark, stored[0], DAY)
    pa.remove_partition(spark, stored[0], DAY)
    assert counts(spark, stored) == {OTHER: 2}


def test_add_empty(spark, stored):
    pa.add_partition(spark, stored[0], TEMP, stored[1])
    pa.add_partition(spark, stored[0], TEMP, stored[1])
    pa.add_partition(spark, stored[0], DAY, stored[1])
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}
    values = pa.partition_values(spark, stored[0])
    assert pa.resolve_partition(values, "20260308") == DAY
    assert sorted(r.ds for r in values.collect()) == [DAY, TEMP, OTHER]
    assert pa.resolve_partition(values, "20260308temp") == TEMP
    assert pa.read_partition(spark, stored[0], TEMP, stored[1]).count() == 0


def test_append(spark, stored):
    pa.append_rows(spark, stored[0], DAY, [{"id": "mock_id", "amount": 5}], stored[1])
    table = pa.read_table(spark, *stored)
    pa.append_rows(spark, stored[0], TEMP, pa.mock_rows(spark, table.schema, 2), stored[1])
    assert counts(spark, stored) == {DAY: 4, OTHER: 2, TEMP: 2}
    row = pa.read_partition(spark, stored[0], DAY, stored[1]).where("id = 'mock_id'").first()
    assert (row.amount, row.status, row.ds) == (5, None, DAY)


def test_overwrite_in_any_column_order(spark, sample, stored):
    shuffled = sample["tgt"].select("ds", *reversed(COLUMNS))
    for compact in (False, True):
        pa.overwrite_partition(shuffled, stored[0], OTHER, stored[1], compact=compact)
        assert counts(spark, stored) == {DAY: 3, OTHER: 2}
        got = pa.read_partition(spark, stored[0], OTHER, stored[1]).select(*COLUMNS)
        assert rows_of(got) == rows_of(sample["tgt"].select(*COLUMNS))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_overwrites_side_by_side(spark, sample, stored):
    days = [f"2026-04-{day:02d}" for day in range(1, 9)]

    def put(ds):
        pa.overwrite_partition(sample["tgt"], stored[0], ds, stored[1])

    for _ in range(2):
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(put, days))
    assert counts(spark, stored) == {DAY: 3, OTHER: 2, **dict.fromkeys(days, 2)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_failed_overwrite_keeps_the_partition(spark, stored):
    broken = pa.read_partition(spark, stored[0], DAY, stored[1]).withColumn(
        "status", F.when(F.col("id") == "3", F.raise_error(F.lit("boom"))).otherwise(F.col("status"))
    )
    with pytest.raises(Exception, match="boom"):
        pa.overwrite_partition(broken, stored[0], DAY, stored[1])
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}


def test_sizes(spark, stored):
    sizes = pa.table_size(spark, stored[0], human=True)
    rows = {r.ds: r for r in sizes.collect()}
    assert set(rows) == {DAY, OTHER}
    assert all(r.total_bytes > 0 and r.file_count >= 1 and r["size"].endswith((" B", " K")) for r in rows.values())
    one = pa.table_size(spark, stored[0], DAY).first()
    assert (one.ds, one.total_bytes) == (DAY, rows[DAY].total_bytes)


def test_schema_change(spark, stored):
    target, _ = stored
    if "/" in target:
        with pytest.raises(ValueError):
            pa.change_schema(spark, target, add={"x": "int"})
        return
    pa.change_schema(spark, target, add={"risk_level": "string"})
    assert spark.table(target).columns == [*COLUMNS, "risk_level", "ds"]
    pa.change_schema(spark, target, rename={"amount": "total_amount"}, cast={"amount": "bigint"})
    table = spark.table(target)
    assert table.columns == [*["total_amount" if c == "amount" else c for c in COLUMNS], "risk_level", "ds"]
    assert dict(table.dtypes)["total_amount"] == "bigint"
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}
    assert not spark.catalog.tableExists(f"{target}__before")
    pa.clean_partition(spark, target, DAY, F.col("status") == "deleted")
    assert counts(spark, stored) == {DAY: 2, OTHER: 2}


def test_schema_change_gives_the_old_table_its_name_back(spark, stored, monkeypatch):
    target, _ = stored
    if "/" in target:
        pytest.skip("catalog tables only")
    run = type(spark).sql

    def failing(session, text, *args, **kwargs):
        if text.startswith(f"ALTER TABLE {target}__after RENAME"):
            raise OSError("no catalog")
        return run(session, text, *args, **kwargs)

    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "sql", failing)
        with pytest.raises(OSError):
            pa.change_schema(spark, target, rename={"amount": "total_amount"})
    assert spark.table(target).columns == [*COLUMNS, "ds"]
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}
    assert not any(spark.catalog.tableExists(f"{target}{end}") for end in ("__before", "__after"))
    pa.change_schema(spark, target, rename={"amount": "total_amount"})
    assert counts(spark, stored) == {DAY: 3, OTHER: 2}


def test_values_unfit_for_ddl_are_refused(spark, stored):
    for change in (pa.remove_partition, pa.add_partition):
        with pytest.raises(ValueError, match="unsupported"):
            change(spark, stored[0], "x') --")


def test_values_with_escaped_characters_can_be_read(spark, sample, tmp_path):
    target, hour = str(tmp_path / "hours"), "2026-03-08 01:00"
    sample["src"].withColumn("ds", F.lit(hour)).write.format("orc").partitionBy("ds").save(target)
    assert pa.read_partition(spark, target, hour).count() == 3
    assert [r.ds for r in pa.partition_values(spark, target).collect()] == [hour]
    assert pa.resolve_partition(pa.partition_values(spark, target), "2026030801:00") == hour
