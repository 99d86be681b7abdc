"""The high-water mark per (repository, branch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.sources import chains
from gitstrata.streaming.versions import Versions, last_by

KEY = ["repo_id", "branch"]
SCHEMA = "repo_id string, branch string, last_hash string, updated_at timestamp"


def advance(tracker: DataFrame, batch: DataFrame) -> DataFrame:
    """New tracker after ``batch`` (repo_id, branch, id, created_at, ord).

    Branches without new commits keep their mark; others take the batch's tip, also where it
    is older (a rebased branch).  Only the newest commit of each branch leaves a task.
    """
    place = F.struct("created_at", "ord")
    new = batch.groupBy(*KEY).agg(F.max_by("id", place).alias("_hash"), F.max("created_at").alias("_at"))
    return tracker.select(*KEY, "last_hash", "updated_at").join(new, KEY, "full").select(
        *KEY, F.coalesce("_hash", "last_hash").alias("last_hash"), F.coalesce("_at", "updated_at").alias("updated_at")
    )


def reset(tracker: DataFrame, branches: DataFrame) -> DataFrame:
    return tracker.join(branches.select(*KEY), KEY, "left_anti")


def since_hash(tracker: DataFrame, branches: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Where an incremental read starts: a custom hash, else the mark, else a full read."""
    out = branches.select(*KEY).join(tracker.select(*KEY, "last_hash"), KEY, "left")
    if custom is not None:
        out = out.join(custom.select(*KEY, F.col("since").alias("_since")), KEY, "left")
    else:
        out = out.withColumn("_since", F.lit(None).cast("string"))
    since = F.coalesce("_since", "last_hash")
    return out.select(*KEY, since.alias("since"), since.isNull().alias("full_read"))


def unread(commits: DataFrame, starts: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, branch, id) that each branch's tip reaches and its start does not, whatever their dates.

    ``tips`` has (repo_id, branch, tip); ``starts`` comes from ``since_hash``.  A branch
    without a start, or whose start is no known commit, is read whole; one without a known tip
    gives nothing.  Commits have parent_ids.
    """
    ends = tips.select(*KEY, F.col("tip").alias("until")).join(starts.select(*KEY, "since"), KEY, "left")
    return chains.between(chains.chains(commits), ends, ["branch"])


def incremental(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """Commits of each branch newer than its start; a full read where it has none or does not know it.

    A single scan for commits that carry their branch and arrive in order of time; ``unread``
    goes by reachability.  Newer means later by (created_at, ord).  ``starts`` comes from ``since_hash``.
    """
    place = F.struct("created_at", "ord")
    at = commits.select(*KEY, F.col("id").alias("since"), place.alias("_low"))
    lows = starts.select(*KEY, "since").join(at, [*KEY, "since"], "left").select(*KEY, "_low")
    return commits.join(lows, KEY).where(F.col("_low").isNull() | (place > F.col("_low"))).drop("_low")


def table(spark: SparkSession, folder: str) -> Versions:
    """The tracker table that a stream keeps under ``folder``."""
    return Versions(spark, folder, SCHEMA, last_by(*KEY))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Newest whole version of a tracker table kept by a stream; older versions are not read."""
    return table(spark, folder).table()
