"""Key-based comparison of two tables.

Rows are told apart by what is known of their key:

* ``same``: equal rows of the two sides. Under ``"one_to_one"`` they cancel copy by copy.
* ``changed``: the key's only rows left on each side, which differ.
* ``only_source``, ``only_target``: the other side does not have the key.
* ``extra_source``, ``extra_target``: both sides have the key, but it repeats, so that no row on the other side
  answers to this one. Inserting such a row would make a second row of its key.

How repeated keys are treated (`pairing`): ``"one_to_one"`` (default) as above, linear in the input;
``"sql"``: the literal full outer join, m x n rows for a key held m and n times, without ``extra_*``.

Rows with a NULL in the key never match anything, as under ``=``.

How the default runs: both sides go through one hash aggregation over key and compared values, so
equal rows collapse and hot copies are combined before the shuffle. A second one counts per key, in rows of a
few numbers. Only differing rows travel further: they learn from their key's counts what they are (a join
that adaptive execution broadcasts where few keys differ and splits where one key has many rows), and the two
rows of a changed key are put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partition_audit.functions import any_null, changed_list, differs, metric_rows, named
from partition_audit.operators.frames import common_types, compare_columns

DIFF_TYPES = ("same", "changed", "only_source", "only_target", "extra_source", "extra_target")
PAIRINGS = ("one_to_one", "sql")

# Copies of one row that a single task writes out before the rest is spread over other tasks.
COPIES_PER_CHUNK = 10_000
# Buckets of keys that `differing_buckets` may report to the driver.
MOST_BUCKETS = 1 << 16
# Parts of the target's key set during its first de-duplication.
KEY_PARTS = 16
# Parts over which source rows with a NULL in the key are spread.
NULL_PARTS = 4096


def anti_join(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], target_keys_unique: bool = False
) -> DataFrame:
    """Source rows whose key is not in the target. NULL keys match nothing, so they are returned.

    Repeated target keys are combined before the join's shuffle. Doing that per part leaves the join
    a shuffle of its own on both sides, which is what lets adaptive execution split a hot source
    key; a plain ``distinct`` would share the join's shuffle and block the split. With
    `target_keys_unique` the step is skipped (also right for tables bucketed by the key).

    Rows with a NULL in the key find no partner wherever they go, so they are dealt over all tasks by
    what else they hold, not gathered under the NULL; the source is read once. Tables bucketed by the key
    keep their layout: `target_keys_unique` leaves this step out too.
    """
    wanted = tgt.select(*[named(k) for k in keys])
    if target_keys_unique:
        return src.join(wanted, list(keys), "left_anti").select(*[named(c) for c in src.columns])
    part = F.spark_partition_id() % F.lit(KEY_PARTS)
    wanted = wanted.withColumn("__part", part).distinct().drop("__part")
    left, right = src.alias("__src"), wanted.alias("__tgt")
    same = [F.col(f"__src.{_quoted(k)}") == F.col(f"__tgt.{_quoted(k)}") for k in keys]
    if spread := _null_part(src, keys):
        left = src.withColumn("__null_part", spread[0]).alias("__src")
        right = wanted.withColumn("__null_part", spread[1]).alias("__tgt")
        same.append(F.col("__src.__null_part") == F.col("__tgt.__null_part"))
    return left.join(right, reduce(lambda a, b: a & b, same), "left_anti").select(*[named(c) for c in src.columns])


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _null_part(src: DataFrame, keys: Sequence[str]) -> tuple[Column, Column] | None:
    """Part of a source row (0 unless its key holds a NULL) and of any target key (always 0).

    None where no key can be NULL or nothing in a row can be hashed. The target's zero is worked out from its
    key: a constant would be moved into the join's condition and no longer spread anything.
    """
    nullable = [k for k in keys if src.schema[k].nullable]
    hashed = [named(f.name) for f in src.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    if not nullable or not hashed:
        return None
    missing = reduce(lambda a, b: a | b, [named(k).isNull() for k in nullable])
    dealt = F.pmod(F.xxhash64(*hashed), F.lit(NULL_PARTS))
    nought = F.pmod(F.xxhash64(*[named(k) for k in keys]), F.lit(1))
    return F.when(missing, dealt).otherwise(F.lit(0).cast("bigint")), nought


@dataclass(frozen=True)
class Sides:
    """Both tables cut down to key and compared columns, under names of their own (`keys`, `cols`).

    Types are those that hold both sides' values without loss; maps are held as sorted entry lists.
    """

    src: DataFrame
    tgt: DataFrame
    key_names: list[str]
    col_names: list[str]
    maps: frozenset[str]

    @property
    def keys(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.key_names))]

    @property
    def cols(self) -> list[str]:
        return [f"__c{i}" for i in range(len(self.col_names))]


def align(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    pairing: str = "one_to_one",
) -> Sides:
    """Check names and types and project both sides to what is compared."""
    if not keys:
        raise ValueError("at least one key column is needed")
    if pairing not in PAIRINGS:
        raise ValueError(f"pairing must be one of {PAIRINGS}")
    listed = compare_columns(src, tgt) if compare is None else list(compare)
    own_case = {name.lower(): name for name in src.columns}
    tgt = tgt.toDF(*[own_case.get(name.lower(), name) for name in tgt.columns])
    keys, cols = list(keys), [c for c in listed if c not in set(keys)]
    for side, df in (("source", src), ("target", tgt)):
        if missing := [c for c in [*keys, *cols] if c not in df.columns]:
            raise ValueError(f"columns missing in the {side}: {missing}")
    types = common_types(src, tgt, [*keys, *cols])
    names = [*keys, "diff_type", "changed_columns", *_side_names(cols)]
    if len(set(names)) != len(names):
        raise ValueError(f"report columns clash: {names}")
    maps = frozenset(f"__c{i}" for i, c in enumerate(cols) if isinstance(types[c], T.MapType))

    def cut(df: DataFrame) -> DataFrame:
        def held(name: str, alias: str) -> Column:
            value = named(name) if df.schema[name].dataType == types[name] else named(name).cast(types[name])
            return (F.array_sort(F.map_entries(value)) if alias in maps else value).alias(alias)

        return df.select(
            *[held(c, f"__k{i}") for i, c in enumerate(keys)], *[held(c, f"__c{i}") for i, c in enumerate(cols)]
        )

    return Sides(cut(src), cut(tgt), keys, cols, maps)


def data_diff(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    include_same: bool = False,
    pairing: str = "one_to_one",
) -> DataFrame:
    """Differing rows: keys, `diff_type`, `changed_columns`, then `<col>_src`, `<col>_tgt` per column.

    `changed_columns` is comma-joined in compare-column order and NULL for unmatched rows.
    """
    sides = align(src, tgt, keys, compare, pairing)
    if pairing == "sql":
        typed = _outer_join(sides)
        return _report(typed if include_same else typed.where("__type != 'same'"), sides)
    versions = _versions(sides)
    report = _report(_paired_rest(versions, sides), sides)
    if include_same:
        report = report.unionByName(_report(_matched(versions, sides), sides))
    return report


def data_diff_summary(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    pairing: str = "one_to_one",
) -> DataFrame:
    """Row count per `diff_type` (types that do not occur are left out). Pairs are never built."""
    sides = align(src, tgt, keys, compare, pairing)
    totals = key_tally(sides).agg(*diff_totals(pairing))
    rows = [((name,), F.col(name)) for name in DIFF_TYPES]
    return metric_rows(totals, ["diff_type"], rows, "cnt").where("cnt > 0")


def data_diff_columns(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None
) -> DataFrame:
    """Per compared column, the number of `changed` rows in which it differs."""
    sides = align(src, tgt, keys, compare)
    if not sides.cols:
        raise ValueError("no columns to compare besides the key")
    changed = _paired_rest(_versions(sides), sides).where("__type = 'changed'")
    counts = changed.agg(
        *[
            F.count(F.when(differs(F.col("__src")[c], F.col("__tgt")[c]), 1)).alias(f"m{i}")
            for i, c in enumerate(sides.cols)
        ]
    )
    rows = [((c,), F.col(f"m{i}")) for i, c in enumerate(sides.col_names)]
    return metric_rows(counts, ["column_name"], rows, "mismatch_count")


def key_tally(sides: Sides) -> DataFrame:
    """Per key: rows in source (`s`) and target (`t`), matching copies (`m`) and pairs (`mp`)."""
    wide = T.DecimalType(19, 0)
    return _versions(sides).groupBy(*sides.keys, "__lone").agg(
        F.sum("__s").alias("s"),
        F.sum("__t").alias("t"),
        F.sum(F.least("__s", "__t")).alias("m"),
        F.sum(F.col("__s").cast(wide) * F.col("__t").cast(wide)).alias("mp"),
    ).select("s", "t", "m", "mp")


def checked_tally(sides: Sides, buckets: int) -> DataFrame:
    """`key_tally` of one-to-one pairing without the values of rows in buckets of keys that are equal on both sides.

    Keys are dealt to `buckets` buckets, and each side's rows of a bucket are summed up as two 64-bit hashes a row,
    whatever their order. Where the sums are the same, so are the rows (but for a collision of both hashes), and only
    the source's keys are grouped, for keys that repeat. The rows of all other buckets, and rows with a NULL in the
    key, are compared in full. Nested values are not told apart by hashes; with such columns everything is compared.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in sides.src.schema):
        return key_tally(sides)
    open_buckets = differing_buckets(sides, buckets)
    if len(open_buckets) == buckets:
        return key_tally(sides)
    in_full = any_null(sides.keys) | _key_bucket(sides.keys, buckets).isin(open_buckets)
    rest = replace(sides, src=sides.src.where(in_full), tgt=sides.tgt.where(in_full))
    copies, wide = F.count(F.lit(1)), T.DecimalType(38, 0)
    equal = sides.src.where(~in_full).groupBy(*sides.keys).agg(copies.alias("s"))
    # Pairs (`mp`) are those of the literal join, which this way has no use for.
    equal = equal.select("s", F.col("s").alias("t"), F.col("s").alias("m"), F.lit(None).cast(wide).alias("mp"))
    return key_tally(rest).unionByName(equal)


def differing_buckets(sides: Sides, buckets: int) -> list[int]:
    """Buckets of keys whose rows differ between the sides; at most `buckets` numbers, whatever the tables' size."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets of keys are possible")
    # A hash skips NULLs, so each value is hashed on its own first: its place counts then.
    values = [F.xxhash64(c) for c in [*sides.keys, *sides.cols]]
    hashes = [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]
    # Sums of halves: they stay in range up to two billion rows a bucket.
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.where(~any_null(sides.keys)).select(
            _key_bucket(sides.keys, buckets).alias("bucket"),
            F.lit(sign).cast("bigint").alias("n"),
            *[(F.lit(sign) * half).alias(f"h{i}") for i, half in enumerate(halves)],
        )

    names = ["n", *[f"h{i}" for i in range(len(halves))]]
    sums = side(sides.src, 1).unionByName(side(sides.tgt, -1)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    differing = sums.where(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names]))
    return sorted(row["bucket"] for row in differing.select("bucket").collect())


def _key_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def diff_totals(pairing: str = "one_to_one") -> list[Column]:
    """Aggregates over `key_tally`, one per diff type."""
    s, t, m = F.col("s"), F.col("t"), F.col("m")
    extra_source = extra_target = F.lit(0)
    if pairing == "sql":
        wide = T.DecimalType(19, 0)
        matched = (s > 0) & (t > 0)
        same = F.sum("mp")
        changed = F.sum(F.when(matched, s.cast(wide) * t.cast(wide) - F.col("mp")))
        only_source, only_target = F.sum(F.when(t == 0, s)), F.sum(F.when(s == 0, t))
    else:
        pair = (s - m == 1) & (t - m == 1)
        same, changed = F.sum("m"), F.count(F.when(pair, 1))
        only_source, only_target = F.sum(F.when(t == 0, s)), F.sum(F.when(s == 0, t))
        extra_source, extra_target = (F.sum(F.when(~pair & (s > 0) & (t > 0), side - m)) for side in (s, t))
    totals = (same, changed, only_source, only_target, extra_source, extra_target)
    return [value.alias(name) for name, value in zip(DIFF_TYPES, totals)]


def _side_names(cols: Sequence[str]) -> list[str]:
    return [f"{c}_{end}" for c in cols for end in ("src", "tgt")]


def _values(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(True).alias("__none"))


def _versions(sides: Sides) -> DataFrame:
    """Distinct (key, values) with the copies on each side in `__s` and `__t`.

    `__lone` holds the side of a NULL-key row, so such rows are counted but never cancel out.
    """

    def side(df: DataFrame, from_source: bool) -> DataFrame:
        return df.select(
            *sides.keys,
            *sides.cols,
            F.when(any_null(sides.keys), F.lit(from_source)).alias("__lone"),
            F.lit(int(from_source)).cast("bigint").alias("__s"),
            F.lit(int(not from_source)).cast("bigint").alias("__t"),
        )

    return (
        side(sides.src, True)
        .unionByName(side(sides.tgt, False))
        .groupBy(*sides.keys, *sides.cols, "__lone")
        .agg(F.sum("__s").alias("__s"), F.sum("__t").alias("__t"))
    )


def _paired_rest(versions: DataFrame, sides: Sides) -> DataFrame:
    """Differing rows as (keys, __type, __src struct, __tgt struct)."""
    keys = sides.keys
    s, t, m = F.sum("__s"), F.sum("__t"), F.sum(F.least("__s", "__t"))
    # The key as one value: a filter on its columns would reach one reader of the first shuffle only, and keep the
    # other from sharing it. NULL keys have a side (`__lone`), so they have nothing in common.
    whole_key = F.struct(*keys, "__lone")
    known = (
        versions.groupBy(*keys, "__lone")
        .agg(((s - m == 1) & (t - m == 1)).alias("__pair"), ((s > 0) & (t > 0)).alias("__shared"), ((s > m) | (t > m)).alias("__open"))
        .where("__open and __shared")
        .select(whole_key.alias("__key"), "__pair", "__shared")
    )
    left_over = _chunked(
        versions.where(F.col("__s") != F.col("__t")).select(
            *keys,
            whole_key.alias("__key"),
            _values(sides.cols).alias("__values"),
            (F.col("__s") > F.col("__t")).alias("__in_src"),
            F.abs(F.col("__s") - F.col("__t")).alias("__copies"),
        )
    )
    pair, shared = (F.coalesce(c, F.lit(False)) for c in ("__pair", "__shared"))
    values, in_src = F.col("__values"), F.col("__in_src")
    # The two rows of a pair meet in one group; every other row is a group of its own.
    apart = F.when(~pair, F.struct("__values", "__in_src", "__chunk")).alias("__apart")
    met = left_over.join(known, "__key", "left").groupBy(*keys, apart).agg(
        F.first(F.when(in_src, values), ignorenulls=True).alias("__src"),
        F.first(F.when(~in_src, values), ignorenulls=True).alias("__tgt"),
        F.max("__copies").alias("__copies"),
        F.max(shared).alias("__shared"),
    )
    kind = (
        F.when(F.col("__apart").isNull(), "changed")
        .when(F.col("__shared"), F.when(F.col("__tgt").isNull(), "extra_source").otherwise("extra_target"))
        .otherwise(F.when(F.col("__tgt").isNull(), "only_source").otherwise("only_target"))
    )
    return _repeated(met.select(*keys, kind.alias("__type"), "__src", "__tgt", "__copies"))


def _matched(versions: DataFrame, sides: Sides) -> DataFrame:
    """Rows present on both sides. Only the copies beyond one chunk are spread by a shuffle."""
    copies = F.least("__s", "__t").alias("__copies")
    both = versions.where(F.least("__s", "__t") > 0).select(
        *sides.keys,
        F.lit("same").alias("__type"),
        _values(sides.cols).alias("__src"),
        _values(sides.cols).alias("__tgt"),
        copies,
    )
    first = both.withColumn("__copies", F.least("__copies", F.lit(COPIES_PER_CHUNK)))
    beyond = _chunked(both.where(F.col("__copies") > COPIES_PER_CHUNK)).where("__chunk > 0")
    spread = beyond.repartition(*sides.keys, "__chunk").drop("__chunk")
    return _repeated(first).unionByName(_repeated(spread))


def _chunked(df: DataFrame) -> DataFrame:
    """Split a row standing for many copies into rows of at most COPIES_PER_CHUNK copies."""
    size = COPIES_PER_CHUNK
    chunks = F.expr(f"explode(sequence(0L, (__copies - 1) div {size}))")
    part = F.expr(f"least({size}L, __copies - __chunk * {size}L)")
    return df.withColumn("__chunk", chunks).withColumn("__copies", part)


def _repeated(df: DataFrame) -> DataFrame:
    """One output row per copy."""
    kept = [c for c in df.columns if c != "__copies"]
    return df.select(*kept, F.expr("explode(sequence(1L, __copies))").alias("__copy")).drop("__copy")


def _outer_join(sides: Sides) -> DataFrame:
    """The literal full outer join. A struct per side marks presence, so NULL keys stay apart."""

    def side(df: DataFrame, name: str) -> DataFrame:
        keys = [F.col(k).alias(f"__{name}{i}") for i, k in enumerate(sides.keys)]
        return df.select(*keys, _values(sides.cols).alias(f"__{name}"))

    places = range(len(sides.keys))
    src, tgt = F.col("__src"), F.col("__tgt")
    kind = (
        F.when(tgt.isNull(), "only_source")
        .when(src.isNull(), "only_target")
        .when(differs(src, tgt), "changed")
        .otherwise("same")
    )
    equal = [F.col(f"__src{i}") == F.col(f"__tgt{i}") for i in places]
    return side(sides.src, "src").join(side(sides.tgt, "tgt"), equal, "full_outer").select(
        *[F.coalesce(f"__src{i}", f"__tgt{i}").alias(sides.keys[i]) for i in places],
        kind.alias("__type"),
        src,
        tgt,
    )


def _report(typed: DataFrame, sides: Sides) -> DataFrame:
    both = F.col("__src").isNotNull() & F.col("__tgt").isNotNull()
    values = []
    for c, name in zip(sides.cols, sides.col_names):
        for end in ("src", "tgt"):
            value = F.col(f"__{end}")[c]
            value = F.map_from_entries(value) if c in sides.maps else value
            values.append(value.alias(f"{name}_{end}"))
    return typed.select(
        *[F.col(k).alias(name) for k, name in zip(sides.keys, sides.key_names)],
        F.col("__type").alias("diff_type"),
        F.when(both, changed_list(sides.cols, "__src", "__tgt", sides.col_names)).alias("changed_columns"),
        *values,
    )
