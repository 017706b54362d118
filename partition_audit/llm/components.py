"""Connected components of an edge table, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.shared import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: bigint); component is the smallest node.

    Rounds of large-star and small-star: each node's neighbours are hung on the smallest node around it,
    until every edge leads to the root of its star. The number of rounds grows with the logarithm of a
    component's size. Nothing is collected; each round is written to the shared folder, the one before it deleted.
    The caller may `discard` the result when it is no longer read.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    marks = _marks(current)
    while True:
        large = _hung(current.union(current.select("b", "a")).toDF("u", "v"), larger=True)
        following = written(_hung(large.toDF("u", "v"), larger=False))
        following_marks = _marks(following)
        discard(current)
        current = following
        if following_marks == marks:
            break
        marks = following_marks
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    found.written_path = current.written_path
    return found


def _hung(edges: DataFrame, larger: bool) -> DataFrame:
    """Per node u with smallest neighbour or self m: (v, m) for its larger (or smaller) neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = edges.join(least, edges["u"] == least["k"])
    hung = joined.where("v > u" if larger else "v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        hung = hung.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return hung.where("a > b").distinct()


def _marks(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; three hash sums tell any others apart."""
    sums = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in range(2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
