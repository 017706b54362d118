"""Operators on the sample tables, with the expected rows written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import partition_audit as pa
from tests.conftest import COLUMNS, DAY, rows_of

TEMP = f"{DAY}-temp"


def test_counts(sample):
    assert rows_of(pa.data_num(sample["src"])) == [(3,)]
    assert rows_of(pa.batch_data_num(sample)) == [("aux", 2), ("src", 3), ("tgt", 2)]


def test_field_dist(sample):
    ordered = [tuple(r) for r in pa.field_dist(sample["src"], ["status"]).collect()]
    assert ordered == [("deleted", 1), ("hold", 1), ("ok", 1)]
    assert [tuple(r) for r in pa.field_dist(sample["src"], ["cust_id"]).collect()] == [("c2", 2), ("c1", 1)]


def test_nulls(sample):
    checks = pa.null_checks(sample["src"], ["email", "phone", "address"])
    assert checks.columns == ["email_null_count", "phone_null_count", "address_null_count"]
    assert rows_of(checks) == [(1, 1, 0)]
    rates = pa.null_rate(sample["src"], ["email", "phone"])
    assert rates.columns == ["total_count", "email_null_rate", "phone_null_rate"]
    assert rows_of(rates) == [(3, pytest.approx(1 / 3), pytest.approx(1 / 3))]


def test_repeat_check(sample):
    assert rows_of(pa.repeat_check(sample["src"], ["cust_id"])) == [("c2", 2)]
    assert rows_of(pa.repeat_check(sample["src"], ["id"])) == []


def test_check_field_len(sample):
    got = [tuple(r) for r in pa.check_field_len(sample["src"], "address", tie_break=["id"]).collect()]
    assert got == [("1", 5), ("2", 5), ("3", 5)]


def test_group_top_n(sample):
    top = pa.group_top_n(sample["src"], ["cust_id"], [F.desc("updated_at")], 3, tie_break=["id"])
    assert rows_of(top.select("cust_id", "id", "rn")) == [("c1", "1", 1), ("c2", "2", 2), ("c2", "3", 1)]


def test_anti_join(sample):
    missing = pa.anti_join(sample["src"], sample["tgt"], ["id"])
    assert missing.columns == sample["src"].columns
    assert [r["id"] for r in missing.collect()] == ["2"]


@pytest.mark.parametrize("pairing", ["one_to_one", "sql"])
def test_data_diff(sample, pairing):
    diff = pa.data_diff(sample["src"], sample["tgt"], ["id"], include_same=True, pairing=pairing)
    assert rows_of(diff.select("id", "diff_type", "changed_columns")) == [
        ("1", "same", ""),
        ("2", "only_source", None),
        ("3", "changed", "cust_id,amount,status,phone"),
    ]
    row = diff.where("id = '3'").first()
    assert (row.amount_src, row.amount_tgt, row.phone_src, row.phone_tgt) == (None, 70, None, "13800000003")
    without = pa.data_diff(sample["src"], sample["tgt"], ["id"], pairing=pairing)
    assert sorted(r["id"] for r in without.collect()) == ["2", "3"]
    expected = ["id", "diff_type", "changed_columns"]
    assert without.columns == expected + [f"{c}_{s}" for c in COLUMNS[1:] for s in ("src", "tgt")]


@pytest.mark.parametrize("pairing", ["one_to_one", "sql"])
def test_diff_totals(sample, pairing):
    summary = pa.data_diff_summary(sample["src"], sample["tgt"], ["id"], pairing=pairing)
    assert rows_of(summary) == [("changed", 1), ("only_source", 1), ("same", 1)]
    compare = dict(rows_of(pa.data_compare(sample["src"], sample["tgt"], ["id"], pairing=pairing)))
    extra = {"extra_source": 0, "extra_target": 0} if pairing == "one_to_one" else {}
    assert compare == {
        "source_count": 3, "target_count": 2, "source_duplicate_keys": 0, "target_duplicate_keys": 0,
        "only_source": 1, "only_target": 0, "changed": 1, "same": 1, **extra,
    }


def test_diff_columns(sample):
    got = [tuple(r) for r in pa.data_diff_columns(sample["src"], sample["tgt"], ["id"]).collect()]
    assert got == [(c, int(c in ("cust_id", "amount", "status", "phone"))) for c in COLUMNS[1:]]


@pytest.mark.parametrize("pairing", ["one_to_one", "sql"])
def test_table_against_itself(sample, pairing):
    src = sample["src"]
    assert rows_of(pa.data_diff(src, src, ["id"], pairing=pairing)) == []
    assert rows_of(pa.data_diff_summary(src, src, ["id"], pairing=pairing)) == [("same", 3)]


def test_compare_columns(sample):
    assert pa.compare_columns(sample["src"], sample["tgt"]) == COLUMNS
    shuffled = sample["tgt"].select(*reversed(sample["tgt"].columns))
    assert pa.compare_columns(sample["src"], shuffled) == COLUMNS
    upper = sample["tgt"].withColumnRenamed("amount", "AMOUNT")
    assert pa.compare_columns(sample["src"], upper) == COLUMNS
    assert pa.data_diff(sample["src"], upper, ["id"]).count() == 2
    with pytest.raises(ValueError, match="email"):
        pa.compare_columns(sample["src"].schema, sample["tgt"].drop("email").schema)


def test_union_merge(sample):
    merged = pa.union_merge([sample["src"], sample["tgt"]])
    assert sorted(r["id"] for r in merged.collect()) == ["1", "1", "2", "3", "3"]


def test_data_clean(sample):
    cleaned = pa.data_clean(sample["src"], DAY, F.col("status") == "deleted")
    assert sorted(r["id"] for r in cleaned.collect()) == ["1", "2"]


def test_move_partition(sample):
    moved = pa.move_partition(sample["src"], DAY, TEMP)
    assert moved.columns == sample["src"].columns
    assert rows_of(pa.partition_inventory(moved)) == [(DAY, 3), (TEMP, 3)]
    gone = pa.move_partition(sample["src"], DAY, TEMP, drop_source=True)
    assert rows_of(pa.partition_inventory(gone)) == [(TEMP, 3)]


def test_drop_and_add_partition(sample):
    assert pa.drop_partition(sample["src"], DAY).count() == 0
    assert pa.drop_partition(sample["src"], "2026-03-09").count() == 3
    assert rows_of(pa.create_temp_partition(sample["src"], TEMP)) == [(DAY, 3), (TEMP, 0)]
    assert rows_of(pa.create_temp_partition(sample["src"], DAY)) == [(DAY, 3)]


def test_alter_table(sample):
    changed = pa.evolve_schema(sample["src"], {"risk_level": "string"}, {"amount": "total_amount"})
    names = ["total_amount" if c == "amount" else c for c in COLUMNS]
    assert changed.columns == [*names, "risk_level", "ds"]
    assert dict(changed.dtypes)["total_amount"] == "int"
    assert [r["risk_level"] for r in changed.collect()] == [None] * 3


def test_insert_values(spark, sample):
    src = sample["src"]
    more = pa.insert_values(src, pa.mock_rows(spark, src.schema))
    assert more.count() == 4
    row = more.where("id = 'mock_id'").first()
    assert (row.cust_id, row.amount) == ("mock_cust_id", -1)
    assert pa.insert_values(src, [{"id": "7"}]).where("id = '7'").first().status is None


def test_data_validation(sample):
    checks = pa.data_validation(sample["src"], ["email", "amount"], [["id"], ["cust_id"], ["cust_id", "id"]])
    assert [tuple(r) for r in checks.collect()] == [
        ("row_count", "*", 3),
        ("null_count", "email", 1),
        ("null_count", "amount", 1),
        ("duplicate_keys", "id", 0),
        ("duplicate_keys", "cust_id", 1),
        ("duplicate_keys", "cust_id,id", 0),
    ]


def test_resolve_partition(spark):
    known = spark.createDataFrame([(DAY,), (TEMP,), ("2026-03-09",), ("a-b",), ("ab",)], "ds string")
    assert pa.resolve_partition(known, DAY) == DAY
    assert pa.resolve_partition(known, "20260308") == DAY
    assert pa.resolve_partition(known, " 2026/03/08 ") == DAY
    assert pa.resolve_partition(known, "ds=2026-03-08") == DAY
    assert pa.resolve_partition(known, "20260308-TEMP") == TEMP
    assert pa.resolve_partition(known, "ab") == "ab"
    with pytest.raises(LookupError, match="no partition"):
        pa.resolve_partition(known, "2026-04-01")
    with pytest.raises(LookupError, match="ambiguous"):
        pa.resolve_partition(known, "a.b")
