from partition_audit.sources.files import partition_size, table_size
from partition_audit.sources.jdbc import jdbc_append, jdbc_insert_rows, jdbc_read
from partition_audit.sources.tables import (
    partition_values,
    read_partition,
    read_table,
    table_path,
)
from partition_audit.sources.writers import (
    add_partition,
    append_rows,
    change_schema,
    clean_partition,
    copy_partition,
    overwrite_partition,
    recover_partition,
    remove_partition,
)

__all__ = [
    "add_partition",
    "append_rows",
    "change_schema",
    "clean_partition",
    "copy_partition",
    "jdbc_append",
    "jdbc_insert_rows",
    "jdbc_read",
    "overwrite_partition",
    "partition_size",
    "partition_values",
    "read_partition",
    "read_table",
    "recover_partition",
    "remove_partition",
    "table_path",
    "table_size",
]
