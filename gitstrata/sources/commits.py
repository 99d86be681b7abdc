"""Reading commits: message form, filters, ranges and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions import text
from gitstrata.functions.scale import attach, cut
from gitstrata.sources import chains

REMOTE = "refs/remotes/origin/"


def commits_from_log(log: DataFrame) -> DataFrame:
    """Keep the first line of every message."""
    return log.withColumn("message", text.first_line(F.col("message")))


def drop_merges(commits: DataFrame, by: str = "parents") -> DataFrame:
    if by == "message":
        return commits.where(~F.coalesce(F.col("message").startswith("Merge"), F.lit(False)))
    return commits.where(F.coalesce(F.size("parent_ids"), F.lit(0)) <= 1)


def time_window(commits: DataFrame, since=None, until=None) -> DataFrame:
    """Both ends belong to the window; either may be left out.

    The ends take the column's own type, so the filter reaches the scan.
    """
    out, kind = commits, commits.schema["created_at"].dataType
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast(kind))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until).cast(kind))
    return out


def reachable(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, tag, id) of every commit reachable from ``starts`` (same columns), starts included.

    ``tag`` keeps several start sets apart in one pass.
    """
    return chains.reached(chains.chains(commits), starts.select("repo_id", "tag", "id"), ["tag"])


def hash_range(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Commits reachable from ``until`` and not from ``since``.

    ``ranges`` has (repo_id, since, until, tip).  An unknown ``since`` means the
    whole branch from its tip; an unknown ``until`` means the tip.
    """
    ids = commits.select("repo_id", "id")

    def known(col: str) -> DataFrame:
        hit = ids.withColumnRenamed("id", col)
        return ranges.select("repo_id", col).distinct().join(hit, ["repo_id", col], "left_semi").withColumn(f"has_{col}", F.lit(True))

    ends = ranges.join(known("since"), ["repo_id", "since"], "left").join(known("until"), ["repo_id", "until"], "left")
    ends = cut(
        ends.select(
            "repo_id",
            F.when(F.col("has_since"), F.col("since")).alias("since"),
            F.when(F.col("has_until") & (F.col("has_since") | F.col("since").isNull()), F.col("until"))
            .otherwise(F.col("tip")).alias("until"),
        )
    )
    return commits.join(chains.between(chains.chains(commits), ends, []), ["repo_id", "id"], "left_semi")


def hash_range_by_position(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Newest-first list from ``until`` down to just before ``since``.

    Works only when both ends are given; positions are compared as
    (created_at, ord), so no ranking is needed.
    """
    place = F.struct("created_at", "ord")
    at = commits.select("repo_id", "id", place.alias("place"))
    ends = (
        ranges.where(F.col("since").isNotNull() & F.col("until").isNotNull())
        .join(at.select("repo_id", F.col("id").alias("since"), F.col("place").alias("low")), ["repo_id", "since"], "left")
        .join(at.select("repo_id", F.col("id").alias("until"), F.col("place").alias("high")), ["repo_id", "until"], "left")
        .select("repo_id", "low", "high", F.lit(True).alias("ranged"))
    )
    ranged = F.coalesce(F.col("ranged"), F.lit(False))
    inside = (place <= F.col("high")) & (F.col("low").isNull() | (place > F.col("low")))
    return attach(commits, ends, ["repo_id"]).where(~ranged | F.coalesce(inside, F.lit(False))).select(*commits.columns)


def by_author(commits: DataFrame, author: str) -> DataFrame:
    return commits.where(F.col("author_name") == author)


def newest(commits: DataFrame, n: int = 100, per: list[str] | None = None) -> DataFrame:
    """The ``n`` newest commits per repository (ties: latest input first).

    ``row_number <= n`` is pre-limited on the map side, so a hot repository sends
    at most ``n`` rows per task to the shuffle.
    """
    w = Window.partitionBy(*(per or ["repo_id"])).orderBy(F.col("created_at").desc_nulls_last(), F.col("ord").desc())
    return commits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def author_directory(branch_commits: DataFrame, per_branch: int | None = None) -> DataFrame:
    """Distinct (name, email) over all commits, or the newest ``per_branch`` of each branch; null names skipped."""
    recent = branch_commits if per_branch is None else newest(branch_commits, per_branch, ["repo_id", "branch"])
    return (
        recent.where(F.col("author_name").isNotNull())
        .select("repo_id", F.col("author_name").alias("name"), F.col("author_email").alias("email"))
        .distinct()
    )


def branch_directory(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("name").startswith(REMOTE)).withColumn("name", F.expr(f"substring(name, {len(REMOTE) + 1})"))


def root_commits(commits: DataFrame) -> DataFrame:
    """Oldest commit without a parent, per repository."""
    roots = commits.where(F.coalesce(F.size("parent_ids"), F.lit(0)) == 0)
    order = F.struct("created_at", "ord")
    return roots.groupBy("repo_id").agg(F.min_by("id", order).alias("id"), F.min_by("created_at", order).alias("created_at"))


def with_parsed_time(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, text.parse_time(F.col(source)))


def report_window(commits: DataFrame, tracker: DataFrame, now: Column) -> DataFrame:
    """until = now; since = tracker time of (repo, branch), else the oldest commit."""
    oldest = commits.groupBy("repo_id", "branch").agg(F.min("created_at").alias("oldest"))
    marks = tracker.select("repo_id", "branch", F.col("updated_at").alias("marked"))
    return oldest.join(marks, ["repo_id", "branch"], "left").select(
        "repo_id", "branch", F.coalesce("marked", "oldest").alias("since"), now.alias("until")
    )


def hash_defaults(commits: DataFrame) -> DataFrame:
    """Range ends used when none are given."""
    order = F.struct("created_at", "ord")
    ends = commits.groupBy("repo_id").agg(
        F.max_by("id", order).alias("until_hash"),
        F.min_by("id", order).alias("since_hash"),
        F.min_by(F.try_element_at("parent_ids", F.lit(1)), order).alias("_parent"),
    )
    return ends.select(
        "repo_id", "until_hash", "since_hash", F.coalesce("_parent", "since_hash").alias("metrics_since_hash")
    )


def review_scope(commits: DataFrame, repos: DataFrame, deep_scan: bool = False) -> DataFrame:
    n = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce(F.col("n"), F.lit(0))
    scope = (
        F.lit("FULL_SCAN") if deep_scan
        else F.when(count == 1, "DIFF_REVIEW").when(count > 1, "BRANCH_REVIEW").otherwise("FULL_SCAN")
    )
    return repos.select("repo_id").join(n, "repo_id", "left").select("repo_id", count.alias("commit_count"), scope.alias("scope"))


def union_external_log(commits: DataFrame, logs: DataFrame, at: Column) -> DataFrame:
    """Non-blank lines of ``logs`` (repo_id, body) become commits by ``External``.

    The id is a hash of repository and line number plus text, so a retried task writes the same one.
    """
    lines = logs.select("repo_id", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    extra = lines.select(
        "repo_id",
        F.concat(F.lit("external-"), F.sha2(F.concat_ws("|", "repo_id", "pos", "line"), 256)).alias("id"),
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("message"),
        F.lit("External").alias("author_name"),
        at.alias("created_at"),
    )
    return commits.unionByName(extra, allowMissingColumns=True)
