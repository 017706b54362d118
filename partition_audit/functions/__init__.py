from partition_audit.functions.columns import (
    any_null,
    changed_list,
    differs,
    human_bytes,
    metric_rows,
    mock_value,
    named,
    null_count,
    text_length,
)

__all__ = [
    "any_null",
    "changed_list",
    "differs",
    "human_bytes",
    "metric_rows",
    "mock_value",
    "named",
    "null_count",
    "text_length",
]
