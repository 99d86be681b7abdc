"""Broadcasts behind a check of their size, and disk given back early."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut

BROADCAST_ROWS = 100_000  # narrow rows sent to every task at most; more are joined by shuffle


def freed(spark: SparkSession) -> None:
    """Collect the driver's garbage, after which Spark removes shuffle files and checkpoints of tables nobody holds.

    Listeners hold the last plan that has run until another one has: a tiny one takes its place.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df``, written once; shuffle files that only its making needed may then be removed.

    By itself Spark removes them long after the last reader, and only once no plan that has run
    is held: a copy of ``df`` is run, as callers may still hold ``df`` itself.
    """
    kept = cut(df.select("*"))
    freed(df.sparkSession)
    return kept


def sized(narrow: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow``, written once, and marked for broadcast where its counted rows allow it."""
    kept = settled(narrow)
    return F.broadcast(kept) if kept.count() <= most else kept
