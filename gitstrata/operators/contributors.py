"""Contributor activity: counts, shares, ranks and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions import text
from gitstrata.functions.scale import attach, rank_within
from gitstrata.operators.commits import UNKNOWN, display_position

def author() -> Column:
    return F.coalesce(F.col("author_name"), F.lit(UNKNOWN)).alias("author")


def by_category(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", author(), "category").agg(F.count(F.lit(1)).alias("n"))


def category_pivot(commits: DataFrame, categories: list[str]) -> DataFrame:
    wide = commits.groupBy("repo_id", author()).pivot("category", categories).agg(F.count(F.lit(1)))
    return wide.fillna(0, categories)


def by_author(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", author()).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def emails(commits: DataFrame) -> DataFrame:
    """First non-null e-mail per author."""
    seen = commits.where(F.col("author_email").isNotNull())
    return seen.groupBy("repo_id", author()).agg(F.min_by("author_email", "ord").alias("email"))


def shares(counts: DataFrame) -> DataFrame:
    """Share of each author in percent and the low-activity flag.

    The flag compares the unrounded share with a quarter of the average share.
    """
    per_repo = counts.groupBy("repo_id").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_authors"))
    pct = F.col("n") / F.col("_total") * 100.0
    return (
        attach(counts, per_repo, ["repo_id"])
        .withColumn("share", text.half_up2(pct))
        .withColumn("low_activity", pct < 100.0 / F.col("_authors") * 0.25)
        .drop("_total", "_authors")
    )


def ranked(counts: DataFrame) -> DataFrame:
    """Position by count, first seen first among equals."""
    return rank_within(counts, ["repo_id"], [F.col("n").desc(), F.col("first_ord").asc(), F.col("author").asc()], "position")


def contributor_ranking(commits: DataFrame) -> DataFrame:
    return ranked(shares(by_author(commits)))


def category_distribution(commits: DataFrame) -> DataFrame:
    """Category → count per author; at most one entry per category."""
    per = by_category(commits)
    pairs = F.array_sort(F.collect_list(F.struct("category", "n")))
    return per.groupBy("repo_id", "author").agg(F.map_from_entries(pairs).alias("distribution"))


def monthly(commits: DataFrame) -> DataFrame:
    dated = commits.where(F.col("created_at").isNotNull())
    return dated.groupBy("repo_id", author(), F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def low_activity_details(commits: DataFrame) -> DataFrame:
    """Commits of the flagged authors, ready for display."""
    flagged = shares(by_author(commits)).where("low_activity").select("repo_id", "author")
    rows = commits.select(
        "repo_id", author(),
        text.short_id(F.col("id")).alias("short_id"),
        F.col("message"), F.col("category"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"),
        "ord",
    )
    return rows.join(flagged, ["repo_id", "author"], "left_semi")


def main_areas(commits: DataFrame) -> DataFrame:
    """The two largest categories per author, joined.  A group has at most one row per category."""
    w = Window.partitionBy("repo_id", "author").orderBy(F.col("n").desc(), F.col("_place"))
    top = by_category(commits).withColumn("_place", display_position(F.col("category"))).withColumn("_rn", F.row_number().over(w))
    both = F.array_sort(F.collect_list(F.struct("_rn", "category")))
    return (
        top.where("_rn <= 2")
        .groupBy("repo_id", "author")
        .agg(F.array_join(F.transform(both, lambda x: x["category"]), "、").alias("areas"))
    )


def with_preview(commits: DataFrame) -> DataFrame:
    return commits.withColumn("preview", text.preview(F.col("message")))
