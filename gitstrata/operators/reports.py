"""Tables behind the review report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import text
from gitstrata.functions.scale import attach, rank_within

UNASSIGNED = "unassigned"


def _n(severity: str) -> Column:
    return F.count(F.when(F.col("severity") == severity, 1))


def is_confirmed() -> Column:
    return (F.coalesce(F.col("status"), F.lit("")) != "FALSE_POSITIVE") & (F.col("confidence") >= 0.7)


def confirmed(findings: DataFrame) -> DataFrame:
    return findings.where(is_confirmed())


def severity_counts(findings: DataFrame) -> DataFrame:
    aggs = []
    for s in ("P0", "P1", "P2"):
        hit = F.col("severity") == s
        aggs += [F.count(F.when(hit, 1)).alias(f"{s.lower()}_all"), F.count(F.when(hit & is_confirmed(), 1)).alias(f"{s.lower()}_confirmed")]
    return findings.groupBy("repo_id").agg(*aggs)


def scope_facts(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """Commits, changed files and distinct named authors; distinct before counting."""
    authors = commits.groupBy("repo_id", "author_name").agg(F.count(F.lit(1)).alias("n"))
    authors = authors.groupBy("repo_id").agg(F.sum("n").alias("commits"), F.count("author_name").alias("authors"))
    files = diffs.select("repo_id", "path").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    return authors.join(files, "repo_id", "full_outer")


def risk_level(findings: DataFrame) -> DataFrame:
    """Risk and release advice from the confirmed counts."""
    p0, p1 = F.col("p0_confirmed"), F.col("p1_confirmed")
    risk = F.when(p0 >= 3, "severe").when((p0 >= 1) | (p1 >= 5), "high").when(p1 >= 1, "medium").otherwise("low")
    advice = F.when(p0 > 0, "no").when(p1 >= 3, "after fix").when(p1 >= 1, "conditional").otherwise("yes")
    return severity_counts(findings).select("repo_id", p0, p1, risk.alias("risk"), advice.alias("release"))


def deadline(severity: Column, review_date: Column) -> Column:
    """P0 at once, P1 after 3 and P2 after 7 working days, else ``-``."""
    day = review_date.cast("date")
    ahead = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 12)), lambda d: ~F.dayofweek(d).isin(1, 7))
    after = lambda n: F.coalesce(F.date_format(F.element_at(ahead, n), "yyyy-MM-dd"), F.lit("-"))
    return F.when(severity == "P0", "immediate").when(severity == "P1", after(3)).when(severity == "P2", after(7)).otherwise("-")


def with_deadline(findings: DataFrame, review_date: Column) -> DataFrame:
    return findings.withColumn("deadline", deadline(F.col("severity"), review_date))


def handler_tasks(findings: DataFrame, review_date: Column) -> DataFrame:
    """Confirmed findings per handler: count, earliest deadline, severity mix."""
    who = F.when(F.coalesce("candidate_handler", F.lit("")) == "", UNASSIGNED).otherwise(F.col("candidate_handler"))
    per = (
        with_deadline(confirmed(findings), review_date)
        .groupBy("repo_id", who.alias("handler"), "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("deadline") != "-", F.col("deadline"))).alias("due"))
    )
    due = F.when(F.max(F.col("due") == "immediate"), "immediate").otherwise(F.coalesce(F.min("due"), F.lit("-")))
    mix = F.array_sort(F.collect_list(F.concat("severity", F.lit("×"), F.col("n"))))
    return per.groupBy("repo_id", "handler").agg(
        F.sum("n").alias("n"), due.alias("earliest"), F.array_join(mix, " ").alias("mix")
    )


def disposition(findings: DataFrame) -> DataFrame:
    """Report order: severity, file, line; index inside the severity and its size.

    A severity can hold most rows, so positions come from chunked ranking.
    """
    rows = findings.withColumn("severity", F.coalesce("severity", F.lit("P4"))).withColumn("file", F.coalesce("file", F.lit("")))
    order = [F.col("file"), F.col("start_line"), F.col("ord")]
    placed = rank_within(rows, ["repo_id", "severity"], order, "idx")
    sizes = rows.groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("section_size"))
    return attach(placed, sizes, ["repo_id", "severity"])


def code_link(remote: Column, branch: Column, path: Column, start: Column, end: Column) -> Column:
    url = F.regexp_replace(remote, r"\.git$", "")
    url = F.replace(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^git@", ""), F.lit(":"), F.lit("/"))
    host = F.lower(F.substring_index(url, "/", 1))
    project = F.when(url.contains("/"), F.regexp_replace(url, r"^[^/]*/", "")).otherwise("")
    host = F.when(url.contains("/"), host).otherwise(url)
    # Hosts whose file links have no "-" part.
    blob = F.when(host.contains("github.com") | host.contains("gitee.com"), "/blob/").otherwise("/-/blob/")
    lo, hi = F.least(start, end), F.greatest(start, end)
    span = F.when(hi > lo, F.concat(F.lit("-L"), hi)).otherwise("")
    return F.concat(F.lit("https://"), host, F.lit("/"), project, blob, branch, F.lit("/"), path, F.lit("#L"), lo, span)


def module_risk(findings: DataFrame) -> DataFrame:
    """Files, P0 to P4 and risk score per module.

    Rows are first reduced to (module, file), which also makes files distinct.
    """
    module = F.when(F.coalesce("module_name", F.lit("")) == "", "other").otherwise(F.col("module_name"))
    levels = ["P0", "P1", "P2", "P3", "P4"]
    per = findings.groupBy("repo_id", module.alias("module"), "file").agg(*[_n(s).alias(s.lower()) for s in levels])
    out = per.groupBy("repo_id", "module").agg(F.count("file").alias("files"), *[F.sum(s.lower()).alias(s.lower()) for s in levels])
    return out.withColumn("score", F.col("p0") * 10 + F.col("p1") * 5 + F.col("p2") * 2 + F.col("p3"))


def repeated_patterns(findings: DataFrame) -> DataFrame:
    """Categories seen at least twice, their modules and the first non-empty trigger."""
    category = F.coalesce("category", F.lit("OTHER")).alias("category")
    module = F.coalesce("module_name", F.lit("other")).alias("module")
    told = F.col("trigger_text").isNotNull() & (F.col("trigger_text") != "")
    per = findings.groupBy("repo_id", category, module).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(told, F.struct("ord", "trigger_text"))).alias("ex"),
    )
    listed = F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("module"), F.col("n").alias("m"))))
    example = F.trim(F.replace(F.min("ex")["trigger_text"], F.lit("\n"), F.lit(" ")))
    return (
        per.groupBy("repo_id", "category")
        .agg(
            F.sum("n").alias("n"),
            F.array_join(F.transform(listed, lambda x: F.concat(x["module"], F.lit("("), x["m"], F.lit(")"))), ", ").alias("modules"),
            F.coalesce(example, F.lit("-")).alias("example"),
        )
        .where("n >= 2")
    )


def comments_by_file(comments: DataFrame) -> DataFrame:
    """Comments with their place inside the file and the file's comment count."""
    rows = comments.withColumn("path", F.coalesce("path", F.lit("(unknown)")))
    sizes = rows.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("file_comments"))
    return attach(rank_within(rows, ["repo_id", "path"], [F.col("ord")], "idx"), sizes, ["repo_id", "path"], salts=1)


def display_cells(findings: DataFrame) -> DataFrame:
    """Short forms for table cells: text head, path tail, short commit ids."""
    flat = F.trim(F.replace(F.coalesce("trigger_text", F.lit("")), F.lit("\n"), F.lit(" ")))
    return findings.select(
        "ord", text.shorten(flat, 40).alias("text_cell"), text.path_tail(F.coalesce("file", F.lit("")), 40).alias("path_cell")
    )


def short_ids(joined: Column) -> Column:
    """``"id; id"`` with every id cut to 8 characters."""
    parts = F.transform(F.split(joined, "; "), lambda x: F.substring(F.trim(x), 1, 8))
    return F.when(F.coalesce(joined, F.lit("")) == "", "-").otherwise(F.array_join(parts, "; "))
