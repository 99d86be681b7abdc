"""Comparing file snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, modified or deleted between two (repo_id, path, content_hash, content) tables."""
    a = old.select("repo_id", "path", F.col("content_hash").alias("old_hash"), F.col("content").alias("old_content"))
    b = new.select("repo_id", "path", F.col("content_hash").alias("new_hash"), F.col("content").alias("new_content"))
    kind = (
        F.when(F.col("old_hash").isNull(), "ADD")
        .when(F.col("new_hash").isNull(), "DELETE")
        .when(F.col("old_hash") != F.col("new_hash"), "MODIFY")
    )
    return (
        a.join(b, ["repo_id", "path"], "full_outer")
        .withColumn("change_type", kind)
        .where(F.col("change_type").isNotNull())
        .select("repo_id", "path", "change_type", "old_content", "new_content")
    )


def fill_content(diffs: DataFrame, current: DataFrame) -> DataFrame:
    """Missing or empty new content comes from the current snapshot, else it is empty."""
    now = current.select("repo_id", "path", F.col("content").alias("_now"))
    filled = F.coalesce(F.when(F.col("new_content") != "", F.col("new_content")), F.col("_now"), F.lit(""))
    return diffs.join(now, ["repo_id", "path"], "left").withColumn("new_content", filled).drop("_now")
