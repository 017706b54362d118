"""The expected result of every registered query, as SQL that DuckDB runs on the same tables.

`events` stands in for a partitioned table (`ds` derived from `ts`). `orders_v2` is a changed copy of
`orders`; `tgt` one of `lineitem`, compared by a key that repeats on both sides.
"""

from __future__ import annotations

ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ORDERS_V2 = """orders_v2 AS (
  SELECT * REPLACE (
    CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate)
  FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL BY NAME SELECT * REPLACE (-1 - o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey < 20
)"""
LINES_V2 = """src AS (SELECT * FROM lineitem), tgt AS (
  SELECT * REPLACE (
    CASE WHEN l_partkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
    CASE WHEN l_partkey % 19 = 0 THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END AS l_shipdate)
  FROM src WHERE l_partkey % 17 <> 0
  UNION ALL BY NAME SELECT * FROM src WHERE l_partkey % 23 = 0
)"""
PART_V2 = """part_v2 AS (
  SELECT * REPLACE (CASE WHEN p_partkey % 10 = 0 THEN p_size + 5000000000 ELSE CAST(p_size AS BIGINT) END AS p_size)
  FROM part WHERE p_partkey % 7 <> 0
)"""
CUSTOMER_V2 = """customer_v2 AS (
  SELECT * REPLACE (CASE WHEN c_custkey % 500 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal)
  FROM customer WHERE c_custkey % 700 <> 0
)"""
CUSTOMER_VALUES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART_VALUES = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _differs(columns, a="t1", b="t2"):
    return " OR ".join(f"{a}.{c} IS DISTINCT FROM {b}.{c}" for c in columns)


def _changed(columns, a="t1", b="t2"):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {a}.{c} IS DISTINCT FROM {b}.{c} THEN '{c}' END" for c in columns) + ")"


def _sides(columns, a="t1", b="t2"):
    """Both sides' values; a side that is None gives NULLs."""
    return ", ".join(f"{f'{side}.{c}' if side else 'NULL'} AS {c}_{end}" for c in columns for side, end in ((a, "src"), (b, "tgt")))


def _joined(src, tgt, keys, columns):
    """The full outer join, with its type."""
    on = " AND ".join(f"t1.{k} = t2.{k}" for k in keys)
    named = ", ".join(f"coalesce(t1.{k}, t2.{k}) AS {k}" for k in keys)
    return f"""SELECT {named},
  CASE WHEN t2.in_tgt IS NULL THEN 'only_source' WHEN t1.in_src IS NULL THEN 'only_target'
    WHEN {_differs(columns)} THEN 'changed' ELSE 'same' END AS diff_type,
  CASE WHEN t1.in_src AND t2.in_tgt THEN {_changed(columns)} END AS changed_columns,
  {_sides(columns)}
FROM (SELECT *, true AS in_src FROM {src}) t1 FULL OUTER JOIN (SELECT *, true AS in_tgt FROM {tgt}) t2 ON {on}"""


def _metrics(src, tgt, keys, extra):
    """The rows of a comparison of two tables, from `typed`, which has their diff types."""
    repeated = "SELECT COUNT(1) FROM (SELECT 1 FROM {} GROUP BY {} HAVING COUNT(1) > 1) x"
    rows = [f"SELECT 'source_count' AS metric, COUNT(1) AS value FROM {src}", f"SELECT 'target_count', COUNT(1) FROM {tgt}"]
    for side, name in (("source", src), ("target", tgt)):
        rows.append(repeated.format(name, ", ".join(keys)).replace("COUNT(1) FROM (", f"'{side}_duplicate_keys', COUNT(1) FROM (", 1))
    kinds = ["only_source", "only_target", *(["extra_source", "extra_target"] if extra else []), "changed", "same"]
    rows += [f"SELECT '{k}', COUNT(CASE WHEN diff_type = '{k}' THEN 1 END) FROM typed" for k in kinds]
    return "\nUNION ALL ".join(rows)


def _one_to_one(src, tgt, keys, columns):
    """Rows that differ where keys repeat. Equal rows cancel copy by copy; a key's only rows left are a pair; of the
    others, `extra_*` have a key that the other side has too."""
    key = ", ".join(keys)
    where = "coalesce(in_src, 0) = 1 AND coalesce(in_tgt, 0) = 1"

    def lone(side, other, name):
        values = _sides(columns, *((side, None) if name == "source" else (None, side)))
        return f"""SELECT {key}, CASE WHEN EXISTS (SELECT 1 FROM {other} o WHERE {" AND ".join(f"o.{k} = {side}.{k}" for k in keys)})
    THEN 'extra_{name}' ELSE 'only_{name}' END AS diff_type, NULL AS changed_columns, {values}
  FROM {side} JOIN n USING ({key}) WHERE NOT ({where})"""

    return f"""s AS (SELECT * FROM {src} EXCEPT ALL SELECT * FROM {tgt}),
t AS (SELECT * FROM {tgt} EXCEPT ALL SELECT * FROM {src}),
n AS (
  SELECT {key}, SUM(a) AS in_src, SUM(b) AS in_tgt
  FROM (SELECT {key}, 1 AS a, 0 AS b FROM s UNION ALL SELECT {key}, 0, 1 FROM t) u GROUP BY {key}
)
SELECT {key}, 'changed' AS diff_type, {_changed(columns, "s", "t")} AS changed_columns, {_sides(columns, "s", "t")}
  FROM n JOIN s USING ({key}) JOIN t USING ({key}) WHERE {where}
UNION ALL {lone("s", tgt, "source")}
UNION ALL {lone("t", src, "target")}"""


ORACLE_SQL: dict[str, str] = {
    "data_num": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT COUNT(1) AS total_count FROM ev WHERE ds = '2024-01-08'
""",
    "batch_data_num": """
SELECT 'orders' AS table_name, COUNT(1) AS total_count FROM orders
UNION ALL SELECT 'customer', COUNT(1) FROM customer
UNION ALL SELECT 'lineitem', COUNT(1) FROM lineitem
""",
    "field_dist": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT event_type, COUNT(1) AS cnt FROM ev WHERE ds = '2024-01-08' GROUP BY event_type ORDER BY cnt DESC, event_type
""",
    "null_checks": """
SELECT COUNT(CASE WHEN l.quality IS NULL THEN 1 END) AS quality_null_count,
  COUNT(CASE WHEN l.toxic IS NULL THEN 1 END) AS toxic_null_count
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "null_rate": """
SELECT COUNT(*) AS total_count,
  COUNT(CASE WHEN l.quality IS NULL THEN 1 END) / NULLIF(COUNT(*), 0) AS quality_null_rate,
  COUNT(CASE WHEN l.toxic IS NULL THEN 1 END) / NULLIF(COUNT(*), 0) AS toxic_null_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "repeat_check": """
SELECT l_orderkey, l_linenumber, COUNT(1) AS cnt FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(1) > 1
""",
    "repeat_check_text": """
SELECT text, COUNT(1) AS cnt FROM documents GROUP BY text HAVING COUNT(1) > 1
""",
    "check_field_len": """
SELECT doc_id, CAST(length(cast(text as string)) AS BIGINT) AS field_len
FROM documents ORDER BY field_len DESC, doc_id LIMIT 5
""",
    "group_top_n": """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn
  FROM orders) t WHERE rn <= 3
""",
    "anti_join": """
SELECT t1.* FROM documents t1
LEFT JOIN labels t2 ON t1.doc_id = t2.doc_id WHERE t2.doc_id IS NULL
""",
    "anti_join_multi": """
SELECT t1.* FROM lineitem t1
LEFT JOIN lineitem t2 ON t1.l_orderkey = t2.l_orderkey AND t1.l_linenumber = t2.l_linenumber
  AND t2.l_returnflag = 'R'
WHERE t2.l_orderkey IS NULL
""",
    "union_merge": """
SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""",
    "data_diff": f"WITH {ORDERS_V2} SELECT * FROM ({_joined('orders', 'orders_v2', ['o_orderkey'], ORDER_VALUES)}) d WHERE diff_type <> 'same'",
    "data_diff_all_rows": f"WITH {ORDERS_V2} {_joined('orders', 'orders_v2', ['o_orderkey'], ORDER_VALUES)}",
    "data_compare_changed_schema": f"WITH {PART_V2}, typed AS ({_joined('part', 'part_v2', ['p_partkey'], PART_VALUES)}) "
    + _metrics("part", "part_v2", ["p_partkey"], True),
    "data_diff_summary": f"WITH {ORDERS_V2} SELECT diff_type, COUNT(1) AS cnt FROM ({_joined('orders', 'orders_v2', ['o_orderkey'], ORDER_VALUES)}) d GROUP BY diff_type",
    "data_diff_columns": f"WITH {ORDERS_V2} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(CASE WHEN t1.{c} IS DISTINCT FROM t2.{c} THEN 1 END) AS mismatch_count "
        "FROM orders t1 JOIN orders_v2 t2 ON t1.o_orderkey = t2.o_orderkey"
        for c in ORDER_VALUES
    ),
    "data_diff_repeated_keys": f"WITH {LINES_V2}, {_one_to_one('src', 'tgt', LINE_KEYS, LINE_VALUES)}",
    "data_compare_repeated_keys": f"WITH {LINES_V2}, typed AS ({_joined('src', 'tgt', LINE_KEYS, LINE_VALUES)}) {_metrics('src', 'tgt', LINE_KEYS, False)}",
    "data_clean": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT * FROM ev WHERE ds <> '2024-01-08' OR NOT coalesce(event_type = 'error', false)
""",
    "move_partition": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT * FROM ev WHERE ds <> '2024-01-08-temp'
UNION ALL SELECT event_id, user_id, event_type, value, props, '2024-01-08-temp' FROM ev WHERE ds = '2024-01-08'
""",
    "move_partition_drop_source": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT * FROM ev WHERE ds NOT IN ('2024-01-08', '2024-01-08-temp')
UNION ALL SELECT event_id, user_id, event_type, value, props, '2024-01-08-temp' FROM ev WHERE ds = '2024-01-08'
""",
    "stored_partition": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT * FROM ev WHERE ds = '2024-01-08'
""",
    "drop_partition": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT * FROM ev WHERE ds <> '2024-01-08'
""",
    "create_temp_partition": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT ds, COUNT(1) AS row_count FROM ev GROUP BY ds
UNION ALL SELECT '2024-01-08-temp', CAST(0 AS BIGINT)
""",
    "insert_values": """
SELECT r_regionkey, r_name FROM region
UNION ALL SELECT CAST(-1 AS INT), 'mock_r_name'
""",
    "alter_table": """
SELECT p_partkey, p_name, p_brand, p_type, p_size AS total_size, p_retailprice,
  CAST(NULL AS STRING) AS risk_level
FROM part
""",
    "alter_table_cast": """
SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size, CAST(p_partkey AS STRING) AS p_partkey) FROM part
""",
    "data_compare_checksums": f"WITH {CUSTOMER_V2}, typed AS ({_joined('customer', 'customer_v2', ['c_custkey'], CUSTOMER_VALUES)}) "
    + _metrics("customer", "customer_v2", ["c_custkey"], True),
    "data_compare": f"WITH {ORDERS_V2}, typed AS ({_joined('orders', 'orders_v2', ['o_orderkey'], ORDER_VALUES)}) "
    + _metrics("orders", "orders_v2", ["o_orderkey"], True),
    "data_validation": """
WITH t AS (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'row_count' AS check_name, '*' AS column_name, COUNT(1) AS value FROM t
UNION ALL SELECT 'null_count', 'quality', COUNT(CASE WHEN quality IS NULL THEN 1 END) FROM t
UNION ALL SELECT 'null_count', 'toxic', COUNT(CASE WHEN toxic IS NULL THEN 1 END) FROM t
UNION ALL SELECT 'duplicate_keys', 'doc_id', COUNT(1) FROM (SELECT doc_id FROM t GROUP BY doc_id HAVING COUNT(1) > 1) x
UNION ALL SELECT 'duplicate_keys', 'text', COUNT(1) FROM (SELECT text FROM t GROUP BY text HAVING COUNT(1) > 1) x
""",
    "partition_inventory": """
WITH ev AS (SELECT event_id, user_id, event_type, value, props, CAST(CAST(ts AS DATE) AS STRING) AS ds FROM events)
SELECT ds, COUNT(1) AS row_count FROM ev GROUP BY ds
""",
    "partition_size": """
SELECT regexp_extract(filename, '([a-z]+)\\.parquet$', 1) AS table_name,
  COUNT(1) AS file_count, CAST(SUM(size) AS BIGINT) AS total_bytes
FROM read_blob('/root/testdata/sf0.01/*.parquet') GROUP BY 1
""",
}
