"""Cleaning, deduplicating and classifying commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions import dims, text

MAX_RULES = 1000
UNKNOWN = "unknown"


def cleaned(commits: DataFrame) -> DataFrame:
    return commits.withColumn("cleaned", text.clean_message(F.col("message")))


def dedupe_by_message(commits: DataFrame) -> DataFrame:
    """First commit per cleaned message; the message becomes the cleaned form, the original is kept.

    The first-row filter is applied before the shuffle as well, so copies of one
    message collapse inside each task.
    """
    rows = cleaned(commits).where(F.length("cleaned") > 0)
    w = Window.partitionBy("repo_id", "cleaned").orderBy("ord")
    first = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return first.withColumn("raw_message", F.col("message")).withColumn("message", F.col("cleaned")).drop("_rn", "cleaned")


def classify(commits: DataFrame, on: str = "message", rules=dims.CATEGORY_RULES) -> DataFrame:
    return commits.withColumn("category", text.rule_category(F.col(on), rules))


def rules_from_table(rules: DataFrame) -> list[tuple[str, str, list[str], list[str]]]:
    """Rules as data: (code, label, prefixes, keywords, priority) rows, pattern lists joined by commas.

    Rules are configuration; the table is read only up to ``MAX_RULES`` rows and
    refused beyond that.
    """
    rows = rules.select("code", "label", "prefixes", "keywords", "priority").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    parts = lambda v: [p.strip() for p in (v or "").split(",") if p.strip()]
    rows = sorted(rows, key=lambda r: (r["priority"], r["code"]))
    return [(r["code"], r["label"], parts(r["prefixes"]), parts(r["keywords"])) for r in rows]


def label(commits: DataFrame, feedback: DataFrame, model_labels: DataFrame, on: str = "message") -> DataFrame:
    """Human feedback by exact message, then rules, then a model's reply, then ``other``.

    ``feedback`` and ``model_labels`` hold one row per repository and message.
    """
    fb = feedback.select("repo_id", F.col("message").alias(on), F.col("category").alias("_fb"))
    ml = model_labels.select("repo_id", F.col("message").alias(on), text.label_in_reply(F.col("reply")).alias("_ml"))
    blank = text.is_blank(F.col(on))
    rule = text.rule_category(F.col(on))
    source = (
        F.when(blank, "rule")
        .when(F.col("_fb").isNotNull(), "feedback")
        .when(rule != "other", "rule")
        .when(F.col("_ml").isNotNull(), "model")
        .otherwise("rule")
    )
    return (
        commits.join(fb, ["repo_id", on], "left")
        .join(ml, ["repo_id", on], "left")
        .withColumn("source", source)
        .withColumn(
            "category",
            F.when(blank, "other").when(F.col("source") == "feedback", F.col("_fb"))
            .when(F.col("source") == "model", F.col("_ml")).otherwise(rule),
        )
        .withColumn("corrected", F.col("source") == "feedback")
        .drop("_fb", "_ml")
    )


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Last write wins per repository and message."""
    return feedback.groupBy("repo_id", "message").agg(F.max_by("category", F.struct("ts", "ord")).alias("category"))


def format_gate(commits: DataFrame, replies: DataFrame) -> DataFrame:
    """Drop commits whose verdict line says fail.

    ``replies`` (batch, reply) holds one verdict per line, in the order of
    ``position`` (from 0) inside the batch.  Lines that are no verdict are skipped.
    """
    lines = F.filter(F.split("reply", "\n"), lambda x: x.contains(dims.VERDICT_PASS))
    verdicts = replies.select("batch", F.posexplode(lines).alias("position", "_line")).select(
        "batch", "position", F.col("_line").contains(dims.VERDICT_FAIL).alias("_fail")
    )
    return (
        commits.join(verdicts, ["batch", "position"], "left")
        .where(~F.coalesce(F.col("_fail"), F.lit(False)))
        .drop("_fail")
    )


def category_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def display_position(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in dims.DISPLAY_ORDER]), category).cast("int")


def categories_in_order(commits: DataFrame) -> DataFrame:
    """Non-empty categories with their fixed position; unknown names count as ``other``."""
    known = F.when(F.col("category").isin(dims.DISPLAY_ORDER), F.col("category")).otherwise("other")
    return (
        commits.groupBy("repo_id", known.alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", display_position(F.col("category")))
    )


def totals(commits: DataFrame) -> DataFrame:
    """Commits and distinct named authors per repository.

    Authors are made distinct first, on (repo, author), so a hot repository is
    counted in many tasks.
    """
    per = commits.groupBy("repo_id", "author_name").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo_id").agg(F.sum("n").alias("commits"), F.count("author_name").alias("authors"))


def group_by_dimension(commits: DataFrame, dimension: str) -> DataFrame:
    key = {
        "AUTHOR": F.coalesce("author_name", F.lit(UNKNOWN)),
        "TIME": F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(UNKNOWN)),
        "BRANCH": F.lit("default"),
    }.get(dimension, F.lit("all"))
    return commits.groupBy("repo_id", key.alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
