"""Tracing fixes back to the commits that introduced the fixed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut, rank_within
from gitstrata.operators import hunks as H
from gitstrata.operators.commits import UNKNOWN


BLAMED_FILE = ["repo_id", "commit_id_at", "path"]


def fix_commits(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("category") == "bugfix")


def single_parent(commits: DataFrame) -> DataFrame:
    return commits.where(F.size("parent_ids") == 1)


def fixed_ranges(fixes: DataFrame, diffs: DataFrame) -> DataFrame:
    """Ranges of old lines of every file a fix touches but does not delete, with the parent to blame."""
    f = cut(single_parent(fixes).select("repo_id", F.col("id").alias("commit_id"), F.element_at("parent_ids", 1).alias("commit_id_at")))
    # A subquery moves down to the scan, a join does not: diffs of other commits go before their texts are made or read.
    ours = diffs.where(F.struct("repo_id", "commit_id").isin(f.select("repo_id", "commit_id")))
    touched = ours.where(F.upper(F.coalesce("change_type", F.lit("MODIFY"))) != "DELETE").join(f, ["repo_id", "commit_id"])
    return H.old_ranges(H.hunks(touched)).select("repo_id", F.col("commit_id").alias("fix_id"), *BLAMED_FILE[1:], "first", "last").distinct()


def blamed_lines(ranges: DataFrame, blame: DataFrame) -> DataFrame:
    """Author and commit of each fixed line; lines outside the file and null authors drop out.

    Ranges meet lines through ``hunks.in_ranges``, so their length costs nothing.  Lines of
    revisions that are not asked for go first; bucket or cluster ``blame`` on (repo, revision,
    path) and it needs no shuffle.
    """
    ranges = cut(ranges)
    blame = blame.where(F.struct("repo_id", "commit_id_at").isin(ranges.select("repo_id", "commit_id_at")))
    b = blame.where(F.col("author_name").isNotNull()).select(*BLAMED_FILE, "line_no", F.col("author_name").alias("author"), "commit_id")
    return H.in_ranges(b, ranges, BLAMED_FILE).select("repo_id", "commit_id_at", "path", "line_no", "fix_id", "author", "commit_id").distinct()


def per_file(blamed: DataFrame, credit: str = "commit") -> DataFrame:
    """Lines per (fix, file, author[, commit]).

    ``credit='commit'`` counts each line for its own commit; ``'first_commit'``
    credits all lines of an author in a file to the commit of the first one.
    """
    if credit == "commit":
        return blamed.groupBy("repo_id", "fix_id", "path", "author", "commit_id").agg(F.count(F.lit(1)).alias("lines"))
    return blamed.groupBy("repo_id", "fix_id", "path", "author").agg(
        F.min_by("commit_id", "line_no").alias("commit_id"), F.count(F.lit(1)).alias("lines")
    )


def across_files(per_file: DataFrame) -> DataFrame:
    """Files and lines per (fix, introducing commit, author); the path list has one entry per file of the fix."""
    return per_file.groupBy("repo_id", "fix_id", "commit_id", "author").agg(
        F.array_sort(F.collect_set("path")).alias("paths"), F.sum("lines").alias("lines")
    )


def with_share(links: DataFrame) -> DataFrame:
    """1 / number of authors of the (fix, commit), and the share by lines."""
    per = links.groupBy("repo_id", "fix_id", "commit_id").agg(
        F.count(F.lit(1)).alias("_authors"), F.sum("lines").alias("_lines")
    )
    return (
        links.join(per, ["repo_id", "fix_id", "commit_id"])
        .withColumn("share", 1.0 / F.col("_authors"))
        .withColumn("line_share", F.col("lines") / F.col("_lines"))
        .drop("_authors", "_lines")
    )


def bug_links(fixes: DataFrame, diffs: DataFrame, blame: DataFrame, credit: str = "commit") -> DataFrame:
    fixes = cut(fixes.select("repo_id", "id", "parent_ids", "author_name", "message", "created_at"))
    links = with_share(across_files(per_file(blamed_lines(fixed_ranges(fixes, diffs), blame), credit)))
    who = fixes.select(
        "repo_id", F.col("id").alias("fix_id"), F.coalesce("author_name", F.lit(UNKNOWN)).alias("fixed_by"),
        F.col("message").alias("fixed_message"), F.col("created_at").alias("fixed_at"),
    )
    return links.join(who, ["repo_id", "fix_id"])


# ---- developers ------------------------------------------------------------------

def commit_totals(commits: DataFrame) -> DataFrame:
    who = F.coalesce("author_name", F.lit(UNKNOWN)).alias("author")
    return commits.groupBy("repo_id", who).agg(F.count(F.lit(1)).alias("total_commits"), F.min_by("author_email", "ord").alias("email"))


def introduced(links: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Bug shares and confirmed / false-positive counts per introducer; no status means confirmed."""
    key = ["repo_id", "fix_id", "commit_id", "author"]
    rows = links if statuses is None else links.join(statuses.select(*key, "status"), key, "left")
    false = (F.col("status") == "FALSE_POSITIVE") if statuses is not None else F.lit(False)
    false = F.coalesce(false, F.lit(False))
    return rows.groupBy("repo_id", "author").agg(
        F.sum("share").alias("bugs_introduced"), F.count(F.lit(1)).alias("links"),
        F.count(F.when(~false, 1)).alias("confirmed"), F.count(F.when(false, 1)).alias("false_positive"),
    )


def fixes(links: DataFrame) -> DataFrame:
    """One row per fixing commit; what it fixed becomes ordered distinct lists."""
    parts = F.array_sort(F.collect_list(F.struct("commit_id", "author", "paths")))
    named = links.where(F.coalesce("fix_id", F.lit("")) != "")
    rows = named.groupBy("repo_id", "fix_id", "fixed_by", "fixed_message", "fixed_at").agg(parts.alias("_p"))
    pick = lambda f: F.array_distinct(F.transform("_p", lambda x: x[f]))
    return rows.withColumn("introducers", pick("author")).withColumn("commits", pick("commit_id")).withColumn(
        "paths", F.array_distinct(F.flatten(F.transform("_p", lambda x: x["paths"])))
    ).drop("_p")


def fix_introducers(links: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per fix, introducing commit and author, with that commit's message; a fix of any size gathers no list."""
    told = commits.select("repo_id", F.col("id").alias("commit_id"), F.col("message").alias("introduced_message"))
    named = links.where(F.coalesce("fix_id", F.lit("")) != "").select("repo_id", "fix_id", "commit_id", "author", "fixed_by").distinct()
    return named.join(told, ["repo_id", "commit_id"], "left").select("repo_id", "fix_id", "commit_id", "author", "fixed_by", "introduced_message")


def fix_paths(per_file: DataFrame) -> DataFrame:
    """One row per fix and file with the lines it took back from each introducing commit."""
    return per_file.where(F.coalesce("fix_id", F.lit("")) != "").groupBy("repo_id", "fix_id", "path", "commit_id").agg(F.sum("lines").alias("lines"))


def fixes_made(links: DataFrame) -> DataFrame:
    one = links.where(F.coalesce("fix_id", F.lit("")) != "").select("repo_id", "fix_id", "fixed_by").distinct()
    return one.groupBy("repo_id", F.col("fixed_by").alias("author")).agg(F.count(F.lit(1)).alias("fixes_made"))


def developer_metrics(commits: DataFrame, links: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Commits, bugs introduced, fixes and bug rate; people seen on either side are kept."""
    k = ["repo_id", "author"]
    out = commit_totals(commits).join(introduced(links, statuses), k, "full_outer").join(fixes_made(links), k, "full_outer")
    out = out.fillna(0, ["total_commits", "bugs_introduced", "links", "confirmed", "false_positive", "fixes_made"])
    rate = F.when(F.col("total_commits") > 0, F.col("bugs_introduced") / F.col("total_commits")).otherwise(0.0)
    return out.withColumn("bug_rate", rate)


def introducer_ranking(metrics: DataFrame) -> DataFrame:
    rows = metrics.where("links > 0").withColumn("_b", F.round("bugs_introduced", 6))
    return rank_within(rows, ["repo_id"], [F.col("_b").desc(), F.col("author")], "position").drop("_b")


def fixer_ranking(links: DataFrame) -> DataFrame:
    """Fixers by number of fixes, with how often they fixed whom (a fix counts once per set of introducers)."""
    f = fixes(links).select("repo_id", F.col("fixed_by").alias("author"), F.array_join("introducers", "; ").alias("target"))
    per = f.groupBy("repo_id", "author", "target").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("repo_id", "author").agg(F.sum("n").alias("fixes_made"), F.count(F.lit(1)).alias("targets"))
    return rank_within(totals, ["repo_id"], [F.col("fixes_made").desc(), F.col("author")], "position")


def fix_targets(links: DataFrame) -> DataFrame:
    f = fixes(links).select("repo_id", F.col("fixed_by").alias("author"), F.array_join("introducers", "; ").alias("target"))
    return f.groupBy("repo_id", "author", "target").agg(F.count(F.lit(1)).alias("n"))


# ---- open findings ---------------------------------------------------------------

def unremediated(findings: DataFrame) -> DataFrame:
    """Open P0 and P1 findings, ready for display."""
    lines = F.when(
        F.col("start_line") > 0,
        F.concat(F.least("start_line", "end_line"), F.lit("-"), F.greatest("start_line", "end_line")),
    ).otherwise("-")
    ids = F.array_join(F.transform("blame_commit_ids", lambda c: F.substring(c, 1, 8)), ", ") if "blame_commit_ids" in findings.columns else F.lit("")
    return findings.where(F.col("severity").isin("P0", "P1")).select(
        "repo_id", "ord", F.coalesce("file", F.lit("-")).alias("file"), lines.alias("lines"), "severity",
        F.coalesce(F.trim(F.replace("trigger_text", F.lit("\n"), F.lit(" "))), F.lit("-")).alias("problem"),
        F.when(F.coalesce("owner", F.lit("")) == "", "unassigned").otherwise(F.col("owner")).alias("owner"),
        F.when(F.coalesce(ids, F.lit("")) == "", "-").otherwise(ids).alias("commits"), "status",
    )


def open_by_owner(findings: DataFrame) -> DataFrame:
    """``"A(50%), B(50%)"`` counts for A and for B."""
    owners = findings.where(F.coalesce("owner", F.lit("")) != "").select(
        "repo_id", "status", F.explode(F.split("owner", ", ")).alias("o")
    )
    name = F.trim(F.regexp_replace("o", r"\(\d+%\)", ""))
    return owners.groupBy("repo_id", name.alias("author")).agg(
        F.count(F.when(F.col("status") == "CONFIRMED", 1)).alias("open_confirmed"), F.count(F.lit(1)).alias("open_total")
    )


def portrait(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Fixed bugs and open findings side by side, with one signal per developer."""
    rows = metrics.join(open_by_owner(findings), ["repo_id", "author"], "left").fillna(0, ["open_confirmed", "open_total"])
    signal = (
        F.when((F.col("open_total") >= 5) & (F.col("open_confirmed") >= 3), "many open findings")
        .when((F.col("open_total") > 0) & (F.col("confirmed") > 0), "confirmed bugs and open findings")
        .when(F.col("open_total") > 0, "open findings")
        .otherwise("-")
    )
    return rows.select("repo_id", "author", "bugs_introduced", "confirmed", "open_confirmed", "open_total", signal.alias("signal"))


def collaboration_signals(metrics: DataFrame, links: DataFrame, fix_count: DataFrame, findings: DataFrame) -> DataFrame:
    """Facts only, as (signal, author, value) rows.  ``fix_count`` has (repo_id, n)."""
    one = lambda df, name, value, who=None: df.select(
        "repo_id", F.lit(name).alias("signal"), (F.col(who) if who else F.lit(None).cast("string")).alias("author"),
        value.cast("double").alias("value"),
    )
    rate = F.when(F.col("total_commits") > 0, F.col("links") / F.col("total_commits") * 100).otherwise(0.0)
    totals = metrics.groupBy("repo_id").agg(F.sum("confirmed").alias("c"), F.sum("false_positive").alias("f"))
    n_links = links.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    high = findings.groupBy("repo_id", "file").agg(F.count(F.when(F.col("severity").isin("P0", "P1"), 1)).alias("h"))
    high = high.groupBy("repo_id").agg(F.sum("h").alias("h"), F.count("file").alias("files")).where("h > 0")
    parts = [
        one(metrics.where("links > 0"), "linked_commit_rate", rate, "author"),
        one(metrics.where("fixes_made > 0"), "fixes_made", F.col("fixes_made"), "author"),
        one(fix_count, "fix_commits", F.col("n")), one(n_links, "bug_links", F.col("n")),
        one(totals, "confirmed", F.col("c")), one(totals, "false_positive", F.col("f")),
        one(high, "open_high", F.col("h")), one(high, "open_files", F.col("files")),
    ]
    return reduce(DataFrame.union, parts)
