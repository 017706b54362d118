"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Without it every column expression costs extra driver round trips to record its call site.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Skewed joins stay split where the result is grouped by the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rank limits reach the map side for any number of rows per group.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # Partition values such as '2026-03-08' stay text; '2026-03-08-temp' is not a date.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(
    app_name: str = "partition_audit",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """How many reducers a shuffle starts with: the number of salts worth using."""
    width = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(width or spark.conf.get("spark.sql.shuffle.partitions"))
