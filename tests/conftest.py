from __future__ import annotations

import pytest
from pyspark.sql import types as T

from partition_audit.session import build_session

DAY = "2026-03-08"
COLUMNS = ["id", "cust_id", "user_id", "amount", "status", "updated_at", "email", "phone", "address"]
SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "amount" else T.StringType()) for c in [*COLUMNS, "ds"]]
)
# The three sample tables.
ROWS = {
    "src": [
        ("1", "c1", "u1", 100, "ok", "2026-03-08 01:00:00", "user1@example.com", "13800000001", "addr1", DAY),
        ("2", "c2", "u2", 50, "hold", "2026-03-08 02:00:00", None, "13800000002", "addr2", DAY),
        ("3", "c2", "u3", None, "deleted", "2026-03-08 03:00:00", "user3@example.com", None, "addr3", DAY),
    ],
    "tgt": [
        ("1", "c1", "u1", 100, "ok", "2026-03-08 01:00:00", "user1@example.com", "13800000001", "addr1", DAY),
        ("3", "c3", "u3", 70, "ok", "2026-03-08 03:00:00", "user3@example.com", "13800000003", "addr3", DAY),
    ],
    "aux": [
        ("8", "c8", "u8", 800, "ok", "2026-03-08 08:00:00", "user8@example.com", "13800000008", "addr8", DAY),
        ("9", "c9", "u9", 900, "review", "2026-03-08 09:00:00", "user9@example.com", "13800000009", "addr9", DAY),
    ],
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    return {name: spark.createDataFrame(rows, SCHEMA) for name, rows in ROWS.items()}


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
