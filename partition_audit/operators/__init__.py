from partition_audit.operators.combine import insert_values, literal_rows, mock_rows, union_merge
from partition_audit.operators.compare import (
    anti_join,
    data_diff,
    data_diff_columns,
    data_diff_summary,
)
from partition_audit.operators.evolve import evolve_schema
from partition_audit.operators.frames import (
    compare_columns,
    day_slice,
    partition_filter,
    partition_inventory,
    resolve_partition,
    with_day_partition,
)
from partition_audit.operators.partitions import (
    create_temp_partition,
    data_clean,
    drop_partition,
    move_partition,
)
from partition_audit.operators.profile import (
    batch_data_num,
    check_field_len,
    data_num,
    field_dist,
    null_checks,
    null_rate,
    repeat_check,
)
from partition_audit.operators.rank import group_top_n

__all__ = [
    "anti_join",
    "batch_data_num",
    "check_field_len",
    "compare_columns",
    "create_temp_partition",
    "data_clean",
    "data_diff",
    "data_diff_columns",
    "data_diff_summary",
    "data_num",
    "day_slice",
    "drop_partition",
    "evolve_schema",
    "field_dist",
    "group_top_n",
    "insert_values",
    "literal_rows",
    "mock_rows",
    "move_partition",
    "null_checks",
    "null_rate",
    "partition_filter",
    "partition_inventory",
    "repeat_check",
    "resolve_partition",
    "union_merge",
    "with_day_partition",
]
