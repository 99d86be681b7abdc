"""Checks that accept, downgrade or reject findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import dims, text
from gitstrata.functions.scale import Rounds, widest
from gitstrata.operators import findings as N


def line_count(content: Column) -> Column:
    """Lines of a text; a line break at the end opens no new line."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content == "", 0).otherwise(breaks + F.when(content.endswith("\n"), 0).otherwise(1))


def evidence_key(evidence: Column) -> Column:
    """First trimmed evidence line longer than five characters."""
    lines = F.transform(F.split(evidence, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.try_element_at(F.filter(lines, lambda x: F.length(x) > 5), F.lit(1))


def line_of(content: Column, at: Column) -> Column:
    """Number of the line that holds the character at position ``at``."""
    before = F.substring(content, F.lit(1), at - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def locate_evidence(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (repo_id, file, key) with the first source line that contains the key.

    The key is a single line, so its first position in the whole text names the
    line; no lines are spread out and no pairs within a file are formed.
    """
    keys = findings.select("repo_id", "file", evidence_key(F.col("evidence")).alias("key")).where("key IS NOT NULL").distinct()
    text_of = sources.select("repo_id", F.col("path").alias("file"), "content")
    at = F.instr(F.col("content"), F.col("key"))
    line = line_of(F.col("content"), at)
    return keys.join(text_of, ["repo_id", "file"]).where(at > 0).select("repo_id", "file", "key", line.cast("int").alias("hit_line"))


def check_lines(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Move findings whose lines cannot be right.

    Non-positive lines become 1, inverted ones are swapped; a start beyond the file,
    or more than ten lines off the first evidence hit, moves to the hit and keeps
    its span; beyond the file without a hit it becomes 1.  Findings meet their file's text by
    file alone, so a step that goes on by file shuffles them no more.
    """
    texts = sources.select("repo_id", F.col("path").alias("file"), F.col("content").alias("_content"))
    total, at = line_count(F.col("_content")), F.instr(F.col("_content"), F.col("key"))
    rows = findings.withColumn("key", evidence_key(F.col("evidence"))).join(texts, ["repo_id", "file"], "left")
    rows = rows.withColumn("_total", total).withColumn("_hit", at)
    rows = rows.withColumn("hit_line", F.when(F.col("_hit") > 0, line_of(F.col("_content"), F.col("_hit"))).cast("int"))
    low = F.col("start_line") <= 0
    s0 = F.when(low, 1).otherwise(F.col("start_line"))
    e0 = F.when(low, 1).otherwise(F.col("end_line"))
    rows = rows.withColumn("_s", F.least(s0, e0)).withColumn("_e", F.greatest(s0, e0))
    known = F.coalesce(F.col("_total"), F.lit(0)) > 0
    beyond = known & (F.col("_s") > F.col("_total"))
    hit = F.col("hit_line")
    move = hit.isNotNull() & (beyond | (known & (F.abs(hit - F.col("_s")) > 10)))
    start = F.when(move, hit).when(beyond, 1).otherwise(F.col("_s"))
    end = F.when(move, hit + F.col("_e") - F.col("_s")).when(beyond, 1).otherwise(F.col("_e"))
    out = rows.withColumn("start_line", start.cast("int")).withColumn("end_line", end.cast("int"))
    return out.select(*findings.columns)


def is_guarded(evidence: Column) -> Column:
    return text.lit_or([F.coalesce(evidence.rlike(p), F.lit(False)) for p in dims.GUARD_PATTERNS])


def guard_hit() -> Column:
    return is_guarded(F.col("evidence")) & (F.col("confidence") < 0.8)


def guarded_false_positives(findings: DataFrame) -> DataFrame:
    hit = guard_hit()
    return (
        findings.withColumn("_hit", hit)
        .withColumn("severity", F.when(F.col("_hit"), "P3").otherwise(F.col("severity")))
        .withColumn("status", F.when(F.col("_hit"), "FALSE_POSITIVE").otherwise(F.col("status")))
        .withColumnRenamed("_hit", "guarded")
    )


def missing_triggers(findings: DataFrame) -> DataFrame:
    hit = F.col("severity").isin("P0", "P1") & text.is_blank(F.regexp_replace("trigger_text", r"\s+", " "))
    return findings.withColumn("no_trigger", hit).withColumn("severity", F.when(hit, "P2").otherwise(F.col("severity")))


def check_calls(findings: DataFrame, resolved: DataFrame, callers: DataFrame) -> DataFrame:
    """Lower the confidence of findings the call graph contradicts.

    ``resolved`` (repo_id, symbol, target) maps symbols to graph nodes; ``callers``
    (repo_id, target, callers, transactional) counts callers per node.
    """
    facts = resolved.join(callers, ["repo_id", "target"], "left").select(
        "repo_id", "symbol",
        F.coalesce("callers", F.lit(0)).alias("_callers"),
        F.coalesce("transactional", F.lit(False)).alias("_tx"),
        F.lit(True).alias("_known"),
    )
    rows = findings.join(facts, ["repo_id", "symbol"], "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    if "guarded" in findings.columns:
        known = known & ~F.col("guarded") & ~F.col("no_trigger")
    factor = (
        F.when(known & (F.col("category") == "TRANSACTION") & F.col("_tx"), 0.75)
        .when(known & (F.col("category") == "RESOURCE_LEAK") & (F.col("_callers") == 0), 0.70)
    )
    return (
        rows.withColumn("call_check", factor.isNotNull())
        .withColumn("confidence", F.col("confidence") * F.coalesce(factor, F.lit(1.0)))
        .select(*findings.columns, "call_check")
    )


def outcomes(findings: DataFrame, resolved: DataFrame, callers: DataFrame) -> DataFrame:
    """Add ``outcome``: rejected (compile errors), downgraded or accepted."""
    rows = check_calls(missing_triggers(guarded_false_positives(findings)), resolved, callers)
    rejected = F.col("category") == "COMPILE_ERROR"
    down = F.col("guarded") | F.col("no_trigger") | F.col("call_check")
    out = rows.withColumn("outcome", F.when(rejected, "rejected").when(down, "downgraded").otherwise("accepted"))
    return out.drop("guarded", "no_trigger", "call_check")


def reject_compile_errors(findings: DataFrame) -> DataFrame:
    return findings.where(F.coalesce(F.col("category"), F.lit("")) != "COMPILE_ERROR")


def review_steps(findings, blame, last_authors, reviews, sources) -> tuple[DataFrame, DataFrame]:
    """(reviewed, merged): raw findings deduplicated, owned and cross reviewed; then masked, with lines checked and overlaps merged.

    What is reviewed is read twice, so it is written as a packed table.
    """
    width = widest(findings, N.FILE)
    owned = N.trace_owner(N.dedupe_exact(findings), blame, last_authors, width=width)
    reviewed = Rounds(findings.sparkSession).lay(N.apply_reviews(owned, reviews))
    return reviewed, N.merge_overlaps(check_lines(N.mask_findings(reviewed), sources), width=width).drop("merged_count")


def review_chain(findings, blame, last_authors, reviews, sources, resolved, callers) -> DataFrame:
    """From raw findings to report input: dedupe, owner, cross review, masking, checks, secrets."""
    reviewed, merged = review_steps(findings, blame, last_authors, reviews, sources)
    secrets = N.secret_findings(reviewed)
    kept = outcomes(merged, resolved, callers).where(F.col("outcome") != "rejected")
    return kept.unionByName(secrets.withColumn("outcome", F.lit("secret")), allowMissingColumns=True)


def review_totals(findings: DataFrame) -> DataFrame:
    """Conclusion, risk and counts per repository."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    per = findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("findings"), n("P0").alias("p0"), n("P1").alias("p1"),
        F.count(F.when(F.col("status") == "CONFIRMED", 1)).alias("confirmed"),
        F.count_distinct("module_name").alias("modules"),
    )
    return per.withColumn("conclusion", F.when(F.col("p0") > 0, "must change").otherwise("should change")).withColumn(
        "risk", F.when((F.col("p0") > 0) | (F.col("p1") >= 3), "high").when(F.col("p1") > 0, "medium").otherwise("low")
    )


# Section headings and field names of a free-text review.
SECTIONS = {
    "change_summary": "代码变更说明",
    "architecture": "架构与依赖分析",
    "code_issues": "潜在代码缺陷",
    "impact": "变更影响范围",
    "test_advice": "测试建议",
    "verdict": "审查结论",
}
FIELDS = {"conclusion": "结论", "risk_level": "风险等级", "key_findings": "关键发现"}


def _has_field(label: str):
    return lambda x: (x.startswith(f"**{label}**") | x.startswith(f"{label}:")) & x.rlike(":.")


def parse_sections(replies: DataFrame) -> DataFrame:
    """Six numbered sections and three named fields of a free-text review, with defaults."""
    body = F.col("body")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.transform(F.split(body, r"(?m)^###\s+\d+\.\s+"), trim)

    def section(title: str) -> Column:
        head = lambda p: F.substring_index(p, "\n", 1)
        hit = F.try_element_at(F.filter(parts, lambda p: head(p).contains(title)), F.lit(-1))
        return trim(F.regexp_replace(hit, r"^[^\n]*", ""))

    out = replies
    for name, title in SECTIONS.items():
        out = out.withColumn(name, section(title))
    for name, label in FIELDS.items():
        lines = F.transform(F.split("verdict", "\n"), trim)
        value = F.regexp_extract(F.try_element_at(F.filter(lines, _has_field(label)), F.lit(1)), r"^[^:]*:(.*)$", 1)
        out = out.withColumn(name, trim(F.regexp_replace(F.regexp_replace(trim(value), r"^\*+\s*", ""), r"\*+$", "")))
    blank = text.is_blank(body)
    guess = F.when(body.contains("通过"), "通过").when(body.contains("需修改"), "需修改").when(body.contains("拒绝"), "拒绝").otherwise("需修改")
    risk = F.when(body.contains("高风险"), "高").when(body.contains("中风险"), "中").otherwise("低")
    return (
        out.withColumn("conclusion", F.when(blank, "审查失败").otherwise(F.coalesce("conclusion", guess)))
        .withColumn("risk_level", F.when(blank, "未知").otherwise(F.coalesce("risk_level", risk)))
        .withColumn("key_findings", F.when(blank, "LLM 返回为空").otherwise(F.col("key_findings")))
        .drop("verdict")
    )
