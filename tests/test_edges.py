"""NULL keys, repeated keys, empty inputs, ties, odd types and bad arguments."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import partition_audit as pa
from tests.conftest import rows_of

PAIRS = "k int, v string, w double"


def one_to_one(src, tgt, include_same):
    """The default pairing rule, spelled out over plain lists of (k, v, w)."""
    out, rest = [], defaultdict(lambda: ([], []))
    counts = (Counter(src), Counter(tgt))
    for row in set(src) | set(tgt):
        s, t = (c[row] for c in counts)
        if row[0] is None:
            out += [(None, "only_source", row[1:], None)] * s + [(None, "only_target", None, row[1:])] * t
            continue
        if include_same:
            out += [(row[0], "same", row[1:], row[1:])] * min(s, t)
        rest[row[0]][0].extend([row[1:]] * (s - min(s, t)))
        rest[row[0]][1].extend([row[1:]] * (t - min(s, t)))
    for key, (left, right) in rest.items():
        if len(left) == len(right) == 1:
            out.append((key, "changed", left[0], right[0]))
        else:
            both = {r[0] for r in src} & {r[0] for r in tgt}
            kind = "extra" if key in both else "only"
            out += [(key, f"{kind}_source", r, None) for r in left]
            out += [(key, f"{kind}_target", None, r) for r in right]
    return sorted(out, key=repr)


def full_outer(src, tgt, include_same):
    out = []
    for row in src:
        hits = [t for t in tgt if t[0] is not None and t[0] == row[0]]
        out += [(row[0], "same" if t == row else "changed", row[1:], t[1:]) for t in hits]
        if not hits:
            out.append((row[0], "only_source", row[1:], None))
    keys = {row[0] for row in src}
    out += [(t[0], "only_target", None, t[1:]) for t in tgt if t[0] is None or t[0] not in keys]
    return sorted((r for r in out if include_same or r[1] != "same"), key=repr)


def as_pairs(diff):
    out = []
    for r in diff.collect():
        src = None if r.diff_type.endswith("_target") else (r.v_src, r.w_src)
        tgt = None if r.diff_type.endswith("_source") else (r.v_tgt, r.w_tgt)
        out.append((r.k, r.diff_type, src, tgt))
        differing = None
        if src and tgt:
            differing = ",".join(c for c, a, b in zip("vw", src, tgt) if a != b)
        assert r.changed_columns == differing
    return sorted(out, key=repr)


def random_side(rng, n):
    return [
        (rng.choice([None, *range(12)]), rng.choice([None, "", "a", "b"]), rng.choice([None, 0.5, 1.5]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("pairing,rule", [("one_to_one", one_to_one), ("sql", full_outer)])
def test_diff_with_null_and_repeated_keys(spark, seed, pairing, rule):
    rng = random.Random(seed)
    src, tgt = random_side(rng, 40), random_side(rng, 40)
    frames = [spark.createDataFrame(rows, PAIRS) for rows in (src, tgt)]
    for include_same in (False, True):
        diff = pa.data_diff(*frames, ["k"], include_same=include_same, pairing=pairing)
        assert as_pairs(diff) == rule(src, tgt, include_same)
    expected = Counter(r[1] for r in rule(src, tgt, True))
    assert dict(rows_of(pa.data_diff_summary(*frames, ["k"], pairing=pairing))) == dict(expected)
    compare = dict(rows_of(pa.data_compare(*frames, ["k"], pairing=pairing)))
    assert {name: compare[name] for name in expected} == dict(expected)
    for side, rows in (("source", src), ("target", tgt)):
        assert compare[f"{side}_count"] == len(rows)
        repeated = sum(n > 1 for n in Counter(r[0] for r in rows).values())
        assert compare[f"{side}_duplicate_keys"] == repeated


def test_diff_of_unique_keys_is_the_same_under_both_pairings(spark):
    src = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    tgt = spark.range(100, 600).select("id", (F.col("id") % 5).alias("v"))
    a, b = (rows_of(pa.data_diff(src, tgt, ["id"], include_same=True, pairing=p)) for p in ("one_to_one", "sql"))
    assert a == b and len(a) == 600


def test_diff_with_two_key_columns(spark):
    src = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 3)], "k1 int, k2 string, v int")
    tgt = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 4)], "k1 int, k2 string, v int")
    got = rows_of(pa.data_diff(src, tgt, ["k1", "k2"]).select("k1", "k2", "diff_type"))
    assert got == [(1, None, "only_source"), (1, None, "only_target"), (2, "b", "changed")]


def test_diff_of_keys_only(spark):
    src, tgt = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    got = rows_of(pa.data_diff(src, tgt, ["k"], include_same=True))
    assert got == [(1, "only_source", None), (2, "extra_source", None), (2, "same", ""), (3, "only_target", None)]


def test_diff_nan_and_negative_zero(spark):
    nan = float("nan")
    src = spark.createDataFrame([(1, nan), (2, -0.0), (3, nan)], "k int, w double")
    tgt = spark.createDataFrame([(1, nan), (2, 0.0), (3, None)], "k int, w double")
    for pairing in ("one_to_one", "sql"):
        got = rows_of(pa.data_diff(src, tgt, ["k"], pairing=pairing).select("k", "diff_type"))
        assert got == [(3, "changed")]


def test_diff_nested_types(spark):
    schema = "k int, a array<int>, s struct<x:int,y:string>, m map<string,int>"  # names the plan uses too
    src = spark.createDataFrame([(1, [1, 2], (1, "p"), {"a": 1, "b": 2}), (2, [1], None, {"a": 1})], schema)
    tgt = spark.createDataFrame([(1, [1, 2], (1, "q"), {"b": 2, "a": 1}), (2, None, None, {"a": 2})], schema)
    for pairing in ("one_to_one", "sql"):
        diff = pa.data_diff(src, tgt, ["k"], pairing=pairing)
        assert rows_of(diff.select("k", "changed_columns")) == [(1, "s"), (2, "a,m")]
        assert dict(diff.dtypes)["m_src"] == "map<string,int>"
        assert diff.where("k = 2").first().m_tgt == {"a": 2}
    assert dict(rows_of(pa.data_diff_columns(src, tgt, ["k"]))) == {"a": 1, "s": 1, "m": 1}
    assert rows_of(pa.data_diff_summary(src, tgt, ["k"])) == [("changed", 2)]


def test_diff_of_empty_sides(spark):
    some, none = spark.createDataFrame([(1, "a", 1.0)], PAIRS), spark.createDataFrame([], PAIRS)
    assert [r.diff_type for r in pa.data_diff(some, none, ["k"]).collect()] == ["only_source"]
    assert [r.diff_type for r in pa.data_diff(none, some, ["k"]).collect()] == ["only_target"]
    assert rows_of(pa.data_diff(none, none, ["k"])) == []
    assert rows_of(pa.data_diff_summary(none, none, ["k"])) == []
    assert set(dict(rows_of(pa.data_compare(none, none, ["k"]))).values()) == {0}
    assert rows_of(pa.data_diff_columns(none, none, ["k"])) == [("v", 0), ("w", 0)]


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr("partition_audit.operators.compare.COPIES_PER_CHUNK", 10)
    src = spark.createDataFrame([(1, "a", 1.0)] * 95 + [(2, "b", 1.0)], PAIRS)
    tgt = spark.createDataFrame([(1, "a", 1.0)] * 41 + [(2, "b", 2.0)], PAIRS)
    diff = pa.data_diff(src, tgt, ["k"], include_same=True)
    expected = [("changed", 1), ("extra_source", 54), ("same", 41)]
    assert rows_of(diff.groupBy("diff_type").count()) == expected
    assert rows_of(pa.data_diff_summary(src, tgt, ["k"])) == expected


def test_only_means_that_the_key_is_absent(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, "s"), (3, "s"), (4, "p")], "k int, v string")
    tgt = spark.createDataFrame([(1, "c"), (3, "s"), (4, "q"), (5, "n"), (5, "n")], "k int, v string")
    got = rows_of(pa.data_diff(src, tgt, ["k"]).select("k", "diff_type", "v_src", "v_tgt"))
    assert got == [
        (1, "extra_source", "a", None), (1, "extra_source", "b", None), (1, "extra_target", None, "c"),
        (2, "only_source", "z", None), (3, "extra_source", "s", None), (4, "changed", "p", "q"),
        (5, "only_target", None, "n"), (5, "only_target", None, "n"),
    ]
    want = {"only_source": 1, "only_target": 2, "extra_source": 3, "extra_target": 1, "changed": 1, "same": 1}
    assert dict(rows_of(pa.data_diff_summary(src, tgt, ["k"]))) == want
    compare = dict(rows_of(pa.data_compare(src, tgt, ["k"])))
    assert {k: compare[k] for k in want} == want


def test_diff_across_wider_types_and_odd_names(spark):
    src = spark.createDataFrame([(1, 5, 1.5, [1]), (2, 7, 2.5, None)], "`a.k` int, `v.x` int, f float, n array<int>")
    tgt = spark.createDataFrame([(1, Decimal(5), 1.5, [1]), (2, Decimal(7 + 2**40), 2.5, [2])], "`a.k` bigint, `v.x` decimal(20,0), f double, n array<bigint>")
    diff = pa.data_diff(src, tgt, ["a.k"])
    assert rows_of(diff.select("`a.k`", "diff_type", "changed_columns")) == [(2, "changed", "v.x,n")]
    assert dict(diff.dtypes)["v.x_tgt"] == "decimal(20,0)" and dict(diff.dtypes)["f_src"] == "double"
    assert dict(rows_of(pa.data_diff_columns(src, tgt, ["a.k"]))) == {"v.x": 1, "f": 0, "n": 1}
    assert rows_of(pa.anti_join(src, tgt.where("`a.k` = 1"), ["a.k"]).select("`v.x`")) == [(7,)]
    for kind in ("string", "double", "date"):
        with pytest.raises(TypeError):
            pa.data_diff(src, tgt.withColumn("v.x", F.lit(None).cast(kind)), ["a.k"])


def test_diff_rejects_bad_input(spark):
    src = spark.createDataFrame([(1, "a", 1.0)], PAIRS)
    with pytest.raises(TypeError, match="'w' is double .* int"):
        pa.data_diff(src, src.withColumn("w", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="missing in the target"):
        pa.data_diff(src, src.drop("v"), ["k"], compare=["v"])
    with pytest.raises(ValueError, match="key"):
        pa.data_diff(src, src, [])
    with pytest.raises(ValueError, match="no columns"):
        pa.data_diff_columns(src, src, ["k"], compare=[])
    with pytest.raises(ValueError, match="pairing"):
        pa.data_diff(src, src, ["k"], pairing="all")


def test_anti_join_null_and_repeated_keys(spark):
    src = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4), (2, 4)], "k int, v int")
    tgt = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    for unique in (False, True):
        missing = pa.anti_join(src, tgt, ["k"], target_keys_unique=unique)
        assert rows_of(missing) == [(2, 4), (2, 4), (None, 1)]
    two = spark.createDataFrame([(1, None, {"m": 1}), (None, 2, None), (1, 2, None)], "a int, `b.c` int, m map<string,int>")
    assert pa.anti_join(two, two, ["a", "b.c"]).select("a", "`b.c`").collect() != []
    assert rows_of(pa.anti_join(two, two, ["a", "b.c"]).drop("m")) == rows_of(two.where("a is null or `b.c` is null").drop("m"))
    maps = spark.createDataFrame([(None,), ({"m": 1},)], "m map<string,int>").withColumn("k", F.lit(None).cast("int"))
    assert pa.anti_join(maps.select("k", "m"), tgt, ["k"]).count() == 2
    assert pa.anti_join(src, tgt.where("false"), ["k"]).count() == 5
    assert pa.anti_join(src.where("false"), tgt, ["k"]).count() == 0


def test_clean_keeps_rows_with_unknown_predicate_and_other_partitions(spark):
    rows = [("a", "x", "d1"), ("b", None, "d1"), ("c", "y", "d1"), ("d", "x", "d2"), ("e", "x", None)]
    df = spark.createDataFrame(rows, "id string, status string, ds string")
    kept = pa.data_clean(df, "d1", F.col("status") == "x")
    assert sorted(r.id for r in kept.collect()) == ["b", "c", "d", "e"]


def test_move_onto_filled_partition(spark):
    df = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d3"), ("n", None)], "id string, ds string")
    assert rows_of(pa.move_partition(df, "d1", "d2")) == [("a", "d1"), ("a", "d2"), ("c", "d3"), ("n", None)]
    assert rows_of(pa.drop_partition(df, "d1")) == [("b", "d2"), ("c", "d3"), ("n", None)]
    with pytest.raises(ValueError):
        pa.move_partition(df, "d1", "d1")


@pytest.mark.parametrize("salts", [None, 4])
def test_top_n_ties_and_nulls(spark, salts):
    rows = [(1, 5, 3), (1, 5, 2), (1, 5, 1), (1, None, 0), (None, 7, 1), (None, 7, 0)]
    df = spark.createDataFrame(rows, "g int, o int, t int").repartition(4)
    top = pa.group_top_n(df, ["g"], [F.desc_nulls_last("o")], 2, tie_break=["t"], salts=salts)
    assert rows_of(top) == [(1, 5, 1, 1), (1, 5, 2, 2), (None, 7, 0, 1), (None, 7, 1, 2)]
    assert dict(top.dtypes)["rn"] == "bigint"


def test_field_len_ties_nulls_and_characters(spark):
    df = spark.createDataFrame([(1, "äö"), (2, "abc"), (3, None), (4, "xyz")], "id int, t string")
    got = [tuple(r) for r in pa.check_field_len(df, "t", 4, tie_break=["id"]).collect()]
    assert got == [(2, 3), (4, 3), (1, 2), (3, None)]
    assert [r.id for r in pa.check_field_len(df, "t", 1, tie_break=["id"]).collect()] == [2]


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "v string")
    assert rows_of(pa.repeat_check(df, ["v"])) == [(None, 2)]
    assert [tuple(r) for r in pa.field_dist(df, ["v"]).collect()] == [(None, 2), ("a", 1)]
    checks = pa.data_validation(df, ["v"], [["v"]])
    assert [r.value for r in checks.collect()] == [3, 2, 1]


def test_empty_profiles(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert rows_of(pa.data_num(none)) == [(0,)]
    assert rows_of(pa.null_rate(none, ["a"])) == [(0, None)]
    assert rows_of(pa.null_checks(none, ["a", "b"])) == [(0, 0)]
    for key_sets in ([["a"], ["a", "b"]], []):
        assert {r.value for r in pa.data_validation(none, ["a"], key_sets).collect()} == {0}


def test_union_merge_refuses_mismatches(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows_of(pa.union_merge([a, b])) == [(1, "x"), (2, "y")]
    with pytest.raises(TypeError):
        pa.union_merge([a, b], by_name=False)
    with pytest.raises(ValueError):
        pa.union_merge([a, b.drop("i")])
    same = pa.union_merge([a, a.toDF("p", "q")], by_name=False)
    assert rows_of(same) == [(1, "x"), (1, "x")]


def test_insert_refuses_unknown_columns(spark):
    df = spark.createDataFrame([(1, "x")], T.StructType([T.StructField("i", T.IntegerType(), False), T.StructField("s", T.StringType())]))
    with pytest.raises(ValueError, match="unknown columns"):
        pa.insert_values(df, [{"i": 2, "z": 1}])
    assert rows_of(pa.insert_values(df, [(2, None), {"s": "only"}])) == [(1, "x"), (2, None), (None, "only")]


def test_evolve_schema_checks(spark):
    df = spark.createDataFrame([(1, "7", "d")], "a int, b string, ds string")
    assert pa.evolve_schema(df, cast={"b": "int"}).dtypes == [("a", "int"), ("b", "int"), ("ds", "string")]
    for bad in ({"rename": {"zz": "y"}}, {"rename": {"a": "b"}}, {"add": {"a": "int"}}, {"rename": {"ds": "dt"}}):
        with pytest.raises(ValueError):
            pa.evolve_schema(df, **bad)
