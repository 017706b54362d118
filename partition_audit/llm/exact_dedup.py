"""Exact de-duplication by skew-safe combining.

Copies are combined three times, and each time rows count as equal only if their whole texts are:

1. inside every task (the map side of the first aggregation, whose salt is the task's own),
2. per (salt, digest, text): a text that holds a third of all rows is spread over `SALTS` groups,
3. per (digest, text): at most `SALTS` winners of a text meet.

The digest only decides where rows meet. NULL text counts as empty. Of equal texts the row with the
largest `doc_id` stays (a NULL id loses to any other); rows repeated in whole count as copies of each
other, and one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partition_audit.llm.shared import some_text, written

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combined(docs: DataFrame, digest: Callable[[Column], Column], carried: Column | None) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size and the winner's `carried` columns."""
    text = some_text()
    rows = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
        digest(text).alias("digest"),
        text.alias("whole"),
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        *([carried.alias("row")] if carried is not None else []),
    )
    # A NULL id sorts below every other one; max_by alone would skip it.
    order = F.struct(F.col("keep_id").isNotNull(), "keep_id")
    winner = [F.max_by("row", order).alias("row")] if carried is not None else []
    for keys in (["salt", "digest", "whole"], ["digest", "whole"]):
        rows = rows.groupBy(*keys).agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), *winner
        )
    return rows


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The last step joins rows to their group by digest alone, which is exact for a digest that stands
    for a single text. Whether that holds is known from step 3; texts that share a digest are joined
    by their content.
    """
    groups = _combined(docs, digest, None)
    table = written(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        )
    )
    text = some_text()
    copies = Window.partitionBy("doc_id", "digest").orderBy("text_sha256")
    members = docs.select("doc_id", digest(text).alias("digest"), sha256(text).alias("text_sha256"))
    members = members.withColumn("nth", F.row_number().over(copies))
    found = members.join(table.where("texts = 1"), "digest")
    if not table.where("texts > 1").isEmpty():
        clashing = table.where("texts > 1").select("digest")
        whole = docs.select("doc_id", digest(text).alias("digest"), text.alias("whole")).join(
            clashing, "digest", "left_semi"
        )
        whole = whole.withColumns(
            {
                "text_sha256": sha256(F.col("whole")),
                "nth": F.row_number().over(Window.partitionBy("doc_id", "whole").orderBy("digest")),
            }
        )
        by_text = whole.join(groups, ["digest", "whole"])
        found = found.select(*_RESULT).unionByName(by_text.select(*_RESULT))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


_RESULT = ["doc_id", "keep_id", "group_size", "nth", "text_sha256"]


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns (NULL texts stay NULL)."""
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = _combined(docs, sha256, carried)
    return kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
