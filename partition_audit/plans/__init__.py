from partition_audit.plans.jobs import (
    compare_tables,
    data_compare,
    data_validation,
    diff_tables,
    open_partition,
    validate_table,
)

__all__ = [
    "compare_tables",
    "data_compare",
    "data_validation",
    "diff_tables",
    "open_partition",
    "validate_table",
]
