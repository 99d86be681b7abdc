"""Review findings: parsing, deduplication, ownership and cross review."""

from __future__ import annotations

import re
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from gitstrata.functions import text
from gitstrata.functions.scale import TASK_ROWS, running, widest

# Workers get the repair function itself, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIGH = ["P0", "P1", "P2"]
BLOCK = 64
FILE = ["repo_id", "file"]
FILE_ROWS = 10_000  # findings of one file that are merged as one list, at most

COMMENT_SCHEMA = (
    "comments array<struct<path:string,content:string,category:string,existingCode:string,"
    "suggestionCode:string,startLine:string,endLine:string,thinking:string>>, _corrupt string"
)
_DIRECT = (
    "file:string,filePath:string,file_path:string,startLine:string,line:string,lineStart:string,endLine:string,severity:string,"
    "category:string,confidence:string,evidence:string,trigger:string,suggestedFix:string,suggestionCode:string,"
    "fix:string,symbol:string,method:string"
)
DIRECT_SCHEMA = f"findings array<struct<{_DIRECT}>>, confirmed array<struct<{_DIRECT}>>, _corrupt string"


# A null file takes part in joins and windows under this name.
NO_FILE = "\x00"


# ---- replies to rows -------------------------------------------------------------

def isolate_json(body: Column) -> Column:
    """A fenced block that starts with a brace, else first brace to last brace, else empty."""
    t = F.trim(body)
    fenced = F.regexp_replace(F.regexp_extract(t, r"(?s)```[^\n]*\n(.*?)```", 1), r"^\s+|\s+$", "")
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(fenced.startswith("{"), fenced).otherwise(braces), F.lit(""))


_STRING = re.compile(r'"((?:[^"\\]|\\.|"(?!\s*(?:[:,}\]]|\Z)))*)"', re.S)


def _repair(doc: str | None) -> str | None:
    """Escape quotes and line breaks that stand raw inside string values."""
    if doc is None:
        return None

    def fix(m: re.Match) -> str:
        inner = re.sub(r'\\.|"', lambda c: c.group() if len(c.group()) > 1 else '\\"', m.group(1), flags=re.S)
        return '"' + inner.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'

    return _STRING.sub(fix, doc)


@pandas_udf(StringType())
def repair_json(docs: pd.Series) -> pd.Series:
    return docs.map(_repair, na_action="ignore")


def parse_replies(replies: DataFrame, schema: str) -> DataFrame:
    """Add ``parsed``; a document that does not parse is repaired once and tried again.

    Numbers are read as text and cast field by field, so one odd value costs that value,
    not the reply.  Failed documents are split off first, so no other row passes through Python.
    ``rejected`` marks what still does not parse, for a bad-records table.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true",
               "allowBackslashEscapingAnyCharacter": "true"}
    first = replies.withColumn("json", isolate_json(F.col("body"))).withColumn(
        "parsed", F.from_json("json", schema, options)
    )
    failed = F.coalesce((F.col("json") != "") & F.col("parsed._corrupt").isNotNull(), F.lit(False))
    mended = first.where(failed).withColumn("_fixed", repair_json("json"))
    mended = mended.withColumn("parsed", F.from_json("_fixed", schema, options)).drop("_fixed")
    return first.where(~failed).unionByName(mended).withColumn(
        "rejected", (F.col("json") == "") | F.col("parsed._corrupt").isNotNull()
    )


def whole_number(value: Column) -> Column:
    """``12``, ``"12"`` or ``3.0`` as an int; null for anything else."""
    return F.trim(value).try_cast("double").try_cast("int")


def rejected(replies: DataFrame, schema: str = COMMENT_SCHEMA) -> DataFrame:
    """Replies that hold no readable document, whole, for a table of bad records."""
    return parse_replies(replies, schema).where("rejected").select(*replies.columns)


def comments(replies: DataFrame) -> DataFrame:
    """One row per review comment, in reply order."""
    parsed = parse_replies(replies, COMMENT_SCHEMA).where(~F.col("rejected"))
    keep = [c for c in replies.columns if c != "body"]
    rows = parsed.select(*keep, F.posexplode("parsed.comments").alias("pos", "c")).select(*keep, "pos", "c.*")
    return rows.withColumns({c: whole_number(F.col(c)) for c in ("startLine", "endLine")})


def findings_from_comments(comments: DataFrame) -> DataFrame:
    """Comments become unreviewed findings; a known category wins, else the words decide."""
    named = text.category_from_code(F.col("category"))
    category = F.when(~text.is_blank(F.col("category")) & (named != "OTHER"), named).otherwise(
        text.category_from_text(F.col("content"))
    )
    keep = [c for c in comments.columns if c not in
            {"path", "content", "category", "existingCode", "suggestionCode", "startLine", "endLine", "thinking"}]
    return comments.select(
        *keep,
        F.col("path").alias("file"),
        F.coalesce("startLine", F.lit(0)).alias("start_line"),
        F.coalesce("endLine", F.lit(0)).alias("end_line"),
        category.alias("category"),
        text.severity_from_category(category).alias("severity"),
        F.lit(0.73).alias("confidence"),
        F.lit("UNREVIEWED").alias("status"),
        F.col("existingCode").alias("evidence"),
        F.col("content").alias("trigger_text"),
        F.col("suggestionCode").alias("suggested_fix"),
        F.col("thinking").alias("conclusion"),
    )


def findings_from_json(replies: DataFrame) -> DataFrame:
    """Findings written directly as JSON, with their field aliases and defaults."""
    parsed = parse_replies(replies, DIRECT_SCHEMA).where(~F.col("rejected"))
    keep = [c for c in replies.columns if c != "body"]
    rows = parsed.select(
        *keep, F.posexplode(F.coalesce("parsed.findings", "parsed.confirmed")).alias("pos", "f")
    )
    f = lambda *names: F.coalesce(*[F.col(f"f.{n}") for n in names])
    start = F.coalesce(*[whole_number(F.col(f"f.{n}")) for n in ("startLine", "line", "lineStart")], F.lit(0))
    confidence = F.trim("f.confidence").try_cast("double")
    given = F.upper(F.trim(F.col("f.severity")))
    by_name = {"BLOCKER": "P0", "HIGH": "P1", "MEDIUM": "P2", "LOW": "P3", "INFO": "P4"}
    severity = F.when(given.isNull(), "P2")
    for name, level in by_name.items():
        severity = severity.when(given == name, level)
    return rows.select(
        *keep, "pos",
        f("file", "filePath", "file_path").alias("file"),
        F.when(start <= 0, 1).otherwise(start).alias("start_line"),
        F.when(start <= 0, 1).otherwise(F.coalesce(whole_number(F.col("f.endLine")), F.lit(0))).alias("end_line"),
        text.category_from_code(F.col("f.category")).alias("category"),
        severity.otherwise(text.severity_from_level(F.col("f.severity"))).alias("severity"),
        F.when(F.coalesce(confidence, F.lit(0.0)) <= 0, 0.70).otherwise(confidence).alias("confidence"),
        F.col("f.evidence").alias("evidence"),
        F.col("f.trigger").alias("trigger_text"),
        f("suggestedFix", "suggestionCode", "fix").alias("suggested_fix"),
        f("symbol", "method").alias("symbol"),
    )


def split_merged(findings: DataFrame) -> DataFrame:
    """Findings joined by ``---`` become one row per part; a missing part takes the whole text."""
    merged = F.coalesce(F.col("evidence").contains("---"), F.lit(False)) | F.coalesce(
        F.col("trigger_text").contains("---"), F.lit(False)
    )

    def parts(c: str) -> Column:
        pieces = F.split(c, r"\s*---\s*")
        filled = F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != "")
        last = F.array_max(F.transform(filled, lambda s: s["i"]))
        return F.slice(pieces, 1, F.coalesce(last + 1, F.lit(0)))

    rows = findings.withColumn("_e", parts("evidence")).withColumn("_t", parts("trigger_text"))
    count = F.when(merged, F.greatest(F.coalesce(F.size("_e"), F.lit(1)), F.coalesce(F.size("_t"), F.lit(1)), F.lit(1))).otherwise(1)
    rows = rows.withColumn("_m", merged).withColumn("part", F.explode(F.sequence(F.lit(1), count)))
    pick = lambda a, whole: F.when(
        F.col("_m"), F.coalesce(F.trim(F.try_element_at(a, F.col("part"))), F.col(whole))
    ).otherwise(F.col(whole))
    return (
        rows.withColumn("evidence", pick("_e", "evidence"))
        .withColumn("trigger_text", pick("_t", "trigger_text"))
        .drop("_e", "_t", "_m")
    )


def finding_from_summary(reviews: DataFrame) -> DataFrame:
    """A review summary (key_findings, code_issues, conclusion, risk_level) as one finding."""
    risk = F.trim("risk_level")
    severity = (
        F.when(F.col("risk_level").isNull(), "P4")
        .when(risk.contains("高") | risk.contains("high"), "P1")
        .when(risk.contains("中") | risk.contains("medium"), "P2")
        .otherwise("P3")
    )
    rest = [c for c in reviews.columns if c not in {"key_findings", "code_issues", "conclusion", "risk_level"}]
    return reviews.select(
        *rest,
        F.col("key_findings").alias("evidence"), F.col("code_issues").alias("suggested_fix"), "conclusion",
        F.lit(0.70).alias("confidence"), severity.alias("severity"),
        text.category_from_text(F.col("key_findings")).alias("category"), F.lit("UNREVIEWED").alias("status"),
    )


def finding_from_bug(bugs: DataFrame) -> DataFrame:
    """An attributed bug as a finding: certain, and a logic error."""
    counted = F.col("line_count") > 0
    return bugs.select(
        "repo_id", F.col("path").alias("file"), F.col("author").alias("owner"), F.col("message").alias("evidence"),
        F.col("fixed_message").alias("suggested_fix"),
        F.concat(F.lit("fixed by "), F.coalesce("fixed_by", F.lit("unknown")), F.lit(", at "),
                 F.coalesce(F.col("fixed_at").cast("string"), F.lit("unknown"))).alias("conclusion"),
        F.lit(1.0).alias("confidence"), text.severity_from_text(F.col("message")).alias("severity"),
        F.lit("LOGIC_ERROR").alias("category"), F.lit("UNREVIEWED").alias("status"),
        F.array_compact(F.array("commit_id")).alias("blame_commit_ids"),
        F.when(counted, 1).otherwise(0).alias("start_line"),
        F.when(counted, F.col("line_count")).otherwise(0).cast("int").alias("end_line"),
    )


# ---- deduplication ---------------------------------------------------------------

def _first_of(findings: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_exact(findings: DataFrame) -> DataFrame:
    """Same file, lines and category: keep the longest evidence, the earliest on ties."""
    keys = [F.col(c) for c in ("repo_id", "file", "start_line", "end_line", "category")]
    size = F.coalesce(F.length("evidence"), F.lit(-1))
    return _first_of(findings, keys, [size.desc(), F.col("ord").asc()])


def dedupe_buckets(findings: DataFrame, width: int = 3) -> DataFrame:
    """Same file, line bucket and category: keep the first."""
    bucket = F.expr(f"start_line div {width}")
    return _first_of(findings, [F.col("repo_id"), F.col("file"), bucket, F.col("category")], [F.col("ord").asc()])


MERGED_TEXTS = ["evidence", "suggested_fix", "trigger_text", "conclusion", "owner", "owner_email", "candidate_handler", "symbol"]


def islands(findings: DataFrame) -> DataFrame:
    """Add ``island``: the first line of the run of overlapping findings a row belongs to.

    It depends on file and first line alone, so only those and the farthest last line are
    sorted, once per different first line; texts stay where they are.
    """
    keys, order = ["repo_id", "file"], [F.col("start_line")]
    spans = findings.groupBy(*keys, "start_line").agg(F.max("end_line").alias("end_line"))
    width = widest(spans, keys)
    ends = running(spans, keys, order, {"_reach": ("max", F.col("end_line"))}, inclusive=False, width=width)
    opens = F.col("_reach").isNull() | (F.col("_reach") < F.col("start_line"))
    lines = running(ends, keys, order, {"island": ("max", F.when(opens, F.col("start_line")))}, width=width)
    lines = lines.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "start_line")], "island")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "start_line")])
    return findings.join(lines, same).select(*findings.columns, "island")


def _join_text(acc: Column, nxt: Column) -> Column:
    return (
        F.when(acc == "", nxt).when(acc.contains(nxt), acc).when(nxt.contains(acc), nxt)
        .otherwise(F.concat(acc, F.lit("\n---\n"), nxt))
    )


def _status(rank: Column) -> Column:
    return F.when(rank == 2, "CONFIRMED").when(rank == 1, "FALSE_POSITIVE").otherwise("UNREVIEWED")


def _merged_by_file(findings: DataFrame) -> DataFrame:
    """``merge_overlaps`` where every file fits a task: rows are shuffled once, by file, and each run is one list in line order."""
    order = Window.partitionBy(*FILE).orderBy("start_line", "ord")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_reach").isNull() | (F.col("_reach") < F.col("start_line"))
    rows = findings.withColumn("_reach", reach).withColumn(
        "island", F.max(F.when(opens, F.col("start_line"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    texts = [c for c in MERGED_TEXTS if c in rows.columns]
    first = [c for c in ("module_name", "reviewer") if c in rows.columns]
    ids = [c for c in ("blame_commit_ids",) if c in rows.columns]
    rank = F.when(F.col("status") == "CONFIRMED", 2).when(F.col("status") == "FALSE_POSITIVE", 1).otherwise(0)
    merged = rows.groupBy(*FILE, "island").agg(
        F.max("end_line").alias("end_line"), F.min("severity").alias("severity"), F.max("confidence").alias("confidence"),
        F.max_by("category", F.struct(F.col("confidence"), -F.col("start_line"), -F.col("ord"))).alias("category"),
        F.max(rank).alias("_status"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("merged_count"),
        F.array_sort(F.collect_list(F.struct("start_line", F.col("ord").alias("_ord"), *first, *texts, *ids))).alias("_rows"),
    )

    def folded(c: str) -> Column:
        bodies = F.array_distinct(F.filter(F.transform("_rows", lambda r: r[c]), lambda x: x != ""))
        several = F.when(F.size(bodies) > 0, F.aggregate(bodies, F.lit(""), _join_text))
        return F.when(F.col("merged_count") > 1, several).otherwise(F.col("_rows")[0][c]).alias(c)

    none = F.array().cast("array<string>")
    commits = F.array_distinct(F.flatten(F.transform("_rows", lambda r: F.coalesce(r["blame_commit_ids"], none))))
    return merged.select(
        *FILE, F.col("island").alias("start_line"), "end_line", "severity", "confidence", "category",
        _status(F.col("_status")).alias("status"), "ord", "merged_count", *[F.col("_rows")[0][c].alias(c) for c in first],
        *[folded(c) for c in texts], *[commits.alias(c) for c in ids],
    )


def merge_overlaps(findings: DataFrame, *, width: int | None = None, most: int = FILE_ROWS) -> DataFrame:
    """One finding per run of overlapping line ranges in a file.

    Where no file has more than ``most`` findings, they are shuffled once; ``width`` is
    ``widest`` of the files, if known.

    Scalars are plain aggregates.  Texts are folded in line order; a text that was
    already folded never changes the result, so copies are removed with a grouped
    minimum before anything is collected, and the list that is folded is no longer
    than the text it produces.  Findings without a file are one file.
    """
    if (widest(findings, FILE) if width is None else width) <= most:
        return _merged_by_file(findings)
    rows = islands(findings.withColumn("file", F.coalesce("file", F.lit(NO_FILE))))
    keys = ["repo_id", "file", "island"]
    texts = [c for c in MERGED_TEXTS if c in rows.columns]
    place = F.struct(F.col("start_line"), F.col("ord"))
    first = {c: F.min_by(c, place).alias(c) for c in ("module_name", "reviewer") if c in rows.columns}
    rank = F.when(F.col("status") == "CONFIRMED", 2).when(F.col("status") == "FALSE_POSITIVE", 1).otherwise(0)
    merged = rows.groupBy(*keys).agg(
        F.max("end_line").alias("end_line"),
        F.min("severity").alias("severity"),
        F.max("confidence").alias("confidence"),
        F.max_by("category", F.struct(F.col("confidence"), -F.col("start_line"), -F.col("ord"))).alias("category"),
        F.max(rank).alias("_status"),
        F.min("ord").alias("ord"),
        F.count(F.lit(1)).alias("merged_count"),
        *first.values(),
        *[F.max(c).alias(f"_one_{c}") for c in texts],
    )
    crowded = merged.where("merged_count > 1").select(*keys)
    long = (
        rows.join(crowded, keys, "left_semi")
        .select(*keys, "start_line", "ord", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("body")) for c in texts])).alias("t"))
        .select(*keys, "t.field", "t.body", "start_line", "ord")
        .where(F.col("body").isNotNull() & (F.col("body") != ""))
        .groupBy(*keys, "field", "body")
        .agg(F.min(F.struct("start_line", "ord")).alias("place"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "body")))
    folded = long.groupBy(*keys, "field").agg(
        F.aggregate(ordered, F.lit(""), lambda acc, x: _join_text(acc, x["body"])).alias("body")
    )
    wide = folded.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == c, F.col("body"))).alias(c) for c in texts])
    out = merged.join(wide, keys, "left")
    body = {c: F.when(F.col("merged_count") > 1, F.col(c)).otherwise(F.col(f"_one_{c}")).alias(c) for c in texts}
    out = out.select(
        "repo_id", "file", F.col("island").alias("start_line"), "end_line", "severity", "confidence", "category",
        _status(F.col("_status")).alias("status"), "ord", "merged_count", *first, *body.values(),
    )
    if "blame_commit_ids" in rows.columns:
        ids = (
            rows.select(*keys, "start_line", "ord", F.posexplode("blame_commit_ids").alias("pos", "cid"))
            .groupBy(*keys, "cid").agg(F.min(F.struct("start_line", "ord", "pos")).alias("place"))
            .groupBy("repo_id", "file", F.col("island").alias("start_line"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cid"))), lambda x: x["cid"]).alias("blame_commit_ids"))
        )
        out = out.join(ids, ["repo_id", "file", "start_line"], "left").withColumn(
            "blame_commit_ids", F.coalesce("blame_commit_ids", F.array().cast("array<string>"))
        )
    return out.withColumn("file", F.when(F.col("file") != NO_FILE, F.col("file")))


# ---- ownership -------------------------------------------------------------------

def cover(first: Column, last: Column) -> Column:
    """Pieces of a line range: single lines (level 0) and whole blocks of lines (level 1).

    A range of any length gives at most 2 x BLOCK lines plus one piece per block.
    """
    head = F.floor((first + BLOCK - 1) / BLOCK)
    tail = F.floor((last + 1) / BLOCK) - 1
    lines = lambda a, b: F.when(a <= b, F.sequence(a.cast("long"), b.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = lambda level, arr: F.transform(arr, lambda i: F.struct(F.lit(level).alias("level"), i.alias("idx")))
    whole = tail >= head
    return F.when(
        whole,
        F.concat(at(0, lines(first, head * BLOCK - 1)), at(1, lines(head, tail)), at(0, lines((tail + 1) * BLOCK, last))),
    ).otherwise(at(0, lines(first, last)))


def _blamed(blame: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with an author in the files that have ranges."""
    files = ranges.select("repo_id", F.col("file").alias("path")).distinct()
    return blame.where(F.col("author_name").isNotNull()).join(files, ["repo_id", "path"], "left_semi")


def _pieces(ranges: DataFrame, named: DataFrame) -> DataFrame:
    """Pieces of the part of each range that the file's blamed lines span.

    Line numbers may come from a model's reply: a range can't give more pieces than its file has.
    """
    ends = named.groupBy("repo_id", F.col("path").alias("file")).agg(F.min("line_no").alias("_low"), F.max("line_no").alias("_high"))
    first, last = F.greatest("first", "_low"), F.least("last", "_high")
    inside = ranges.join(ends, ["repo_id", "file"]).where(first <= last)
    return inside.select("repo_id", "file", "first", "last", F.explode(cover(first, last)).alias("p")).select(
        "repo_id", "file", "first", "last", "p.level", "p.idx"
    )


def _levels(named: DataFrame) -> DataFrame:
    line = F.col("line_no").cast("long")
    both = F.array(
        F.struct(F.lit(0).alias("level"), line.alias("idx")),
        F.struct(F.lit(1).alias("level"), F.floor(line / BLOCK).alias("idx")),
    )
    return named.select("repo_id", F.col("path").alias("file"), "line_no", "author_name", F.explode(both).alias("p")).select(
        "repo_id", "file", "p.level", "p.idx", "line_no", "author_name"
    )


PIECE = ["repo_id", "file", "level", "idx"]
RANGE = ["repo_id", "file", "first", "last"]


def trace_owner(findings: DataFrame, blame: DataFrame, last_authors: DataFrame, *, width: int | None = None) -> DataFrame:
    """Author of the first blamed line in the range, else the file's last author; P0 to P2 only.

    Going up a file, the latest blamed line met is the first one at or after a finding's first
    line, so a finding meets one line however long its range is.  ``width`` is ``widest`` of the
    findings' files, if known.
    """
    high = F.coalesce(F.col("severity").isin(HIGH) & (F.col("file") != ""), F.lit(False))
    first, last = F.col("start_line"), F.greatest("start_line", "end_line")
    named = blame.where(F.col("author_name").isNotNull()).select(
        "repo_id", F.col("path").alias("file"), F.col("line_no").alias("_at"), F.struct("line_no", "author_name").alias("_line")
    )
    rows = findings.select("*", first.alias("_at"), last.alias("_last"), high.alias("_high"), F.lit(True).alias("_asks"))
    rows = rows.unionByName(named.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # Of several authors of one line the least stands last.
    order = [F.col("_at").desc(), F.col("_asks"), F.col("_line.author_name").desc()]
    width = (widest(findings, FILE) if width is None else width) + widest(named, FILE)
    met = running(rows, FILE, order, {"_met": ("last", F.col("_line"))}, width=width).where("_asks")
    out = met.join(last_authors.select("repo_id", F.col("path").alias("file"), F.col("author_name").alias("_last_author")), FILE, "left")
    line_author = F.when(F.col("_at").isNotNull() & (F.col("_met.line_no") <= F.col("_last")), F.col("_met.author_name"))
    handler = F.coalesce(line_author, "_last_author")
    hit = F.col("_high") & handler.isNotNull() & (handler != "")
    for c in ("candidate_handler", "owner"):
        out = out.withColumn(c, F.when(hit, handler).otherwise(F.col(c)))
    return out.select(*findings.columns)


def _shares_by_file(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """``owner_shares`` where every file fits a task: ranges and lines are shuffled once, by file, and meet in blocks of lines."""
    rows = asked.unionByName(lines, allowMissingColumns=True).where("repo_id IS NOT NULL AND file IS NOT NULL").repartition(*FILE)
    rows = rows.groupBy(*RANGE, "line_no", "author_name").agg(F.count(F.lit(1)).alias("times"))
    whole, near = Window.partitionBy(*FILE), Window.partitionBy(*FILE, "_block")
    rows = rows.withColumns({"_low": F.min("line_no").over(whole), "_high": F.max("line_no").over(whole)})
    block = lambda c: F.floor(c / BLOCK)
    low, high = F.greatest("first", "_low"), F.least("last", "_high")
    blocks = F.when(F.col("line_no").isNotNull(), F.array(block(F.col("line_no")))).when(low <= high, F.sequence(block(low), block(high)))
    rows = rows.select(*RANGE, "line_no", "author_name", "times", F.explode(blocks).alias("_block"))
    line = F.when(F.col("line_no").isNotNull(), F.struct("line_no", "author_name", "times"))
    met = rows.withColumn("_lines", F.collect_list(line).over(near)).where("line_no IS NULL")
    inside = F.filter("_lines", lambda x: x["line_no"].between(F.col("first"), F.col("last")))
    per = met.select(*RANGE, F.explode(inside).alias("l")).groupBy(*RANGE, F.col("l.author_name").alias("author_name")).agg(F.sum("l.times").alias("lines"))
    return per.withColumn("total", F.sum("lines").over(Window.partitionBy(*RANGE)))


def owner_shares(findings: DataFrame, blame: DataFrame, *, most: int = TASK_ROWS) -> DataFrame:
    """Lines per author over all blamed lines of each distinct range.

    Where no file has more than ``most`` ranges and lines, they are shuffled once.
    """
    asked = findings.select("repo_id", "file", F.col("start_line").alias("first"), F.col("end_line").alias("last")).where("first <= last")
    lines = blame.where("author_name IS NOT NULL").select("repo_id", F.col("path").alias("file"), "line_no", "author_name")
    if widest(asked, FILE) + widest(lines, FILE) <= most:
        return _shares(_shares_by_file(asked, lines))
    ranges = findings.select("repo_id", "file", F.col("start_line").alias("first"), F.col("end_line").alias("last")).distinct()
    named = _blamed(blame, ranges)
    counts = _levels(named).groupBy(*PIECE, "author_name").agg(F.count(F.lit(1)).alias("n"))
    per = _pieces(ranges, named).join(counts, PIECE).groupBy(*RANGE, "author_name").agg(F.sum("n").alias("lines"))
    total = per.groupBy(*RANGE).agg(F.sum("lines").alias("total"))
    return _shares(per.join(total, RANGE))


def _shares(counted: DataFrame) -> DataFrame:
    return counted.select(
        "repo_id", "file", F.col("first").alias("start_line"), F.col("last").alias("end_line"),
        "author_name", "lines", (F.col("lines") / F.col("total")).alias("share"),
    )


def owner_text(shares: DataFrame) -> DataFrame:
    """``A(50%), B(50%)``, largest share first.  One entry per author of the range."""
    entry = F.struct(-F.col("lines"), F.col("author_name"), F.round(F.col("share") * 100).cast("int").cast("string").alias("pct"))
    sorted_entries = F.array_sort(F.collect_list(entry))
    return shares.groupBy("repo_id", "file", "start_line", "end_line").agg(
        F.array_join(F.transform(sorted_entries, lambda e: F.concat(e["author_name"], F.lit("("), e["pct"], F.lit("%)"))), ", ").alias("owner")
    )


# ---- cross review ----------------------------------------------------------------

def apply_reviews(findings: DataFrame, reviews: DataFrame, cap: float = 0.70) -> DataFrame:
    """Second opinions on P0 to P2; findings without one stay as they are."""
    r = reviews.select(
        F.col("ord"),
        F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("_conf"),
        F.col("category").alias("_cat"), F.col("reason").alias("_reason"),
        F.col("trigger_text").alias("_trig"), F.col("suggested_fix").alias("_fix"), F.lit(True).alias("_has"),
    )
    joined = findings.join(r, "ord", "left")
    on = F.coalesce(F.col("_has"), F.lit(False)) & F.col("severity").isin(HIGH)
    mean = (F.col("confidence") + F.col("_conf")) / 2.0
    conf = F.when(text.has_doubt(F.col("_reason")), F.least(mean, F.lit(cap))).otherwise(mean)
    code = text.category_from_code(F.col("_cat"))
    cat = F.when(F.col("_cat").isNotNull() & (code != "OTHER"), code).otherwise(F.col("category"))
    sev = F.when(cat.isNotNull() & (cat != "OTHER"), text.severity_from_category(cat)).otherwise(F.col("severity"))
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    new = {
        "confidence": conf,
        "status": text.status_from_confidence(conf),
        "category": cat,
        "severity": sev,
        "trigger_text": F.when(~empty("_trig") & empty("trigger_text"), F.col("_trig")).otherwise(F.col("trigger_text")),
        "suggested_fix": F.when(~empty("_fix") & empty("suggested_fix"), F.col("_fix")).otherwise(F.col("suggested_fix")),
    }
    kept = [
        (F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c))
        for c in findings.columns if c not in ("conclusion", "reviewer")
    ]
    before = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string")
    return joined.select(
        *kept,
        F.when(on, F.col("_reason")).otherwise(before("conclusion")).alias("conclusion"),
        F.when(on, F.lit("second review")).otherwise(before("reviewer")).alias("reviewer"),
    )


# ---- secrets ---------------------------------------------------------------------

SECRET_FIELDS = ["evidence", "suggested_fix", "trigger_text", "conclusion"]


def mask_findings(findings: DataFrame) -> DataFrame:
    out = findings
    for c in SECRET_FIELDS:
        if c in findings.columns:
            out = out.withColumn(c, text.mask_secrets(F.col(c)))
    return out


def secret_findings(findings: DataFrame) -> DataFrame:
    """A new SECRET_EXPOSURE finding for every row with a secret in one of its texts, already masked.

    ``ord`` is kept, so a repeated run writes the same rows.
    """
    fields = [F.col(c) for c in SECRET_FIELDS if c in findings.columns]
    hits = mask_findings(findings.where(text.has_secret(*fields) & (F.coalesce("category", F.lit("")) != "SECRET_EXPOSURE")))
    return (
        hits.withColumn("category", F.lit("SECRET_EXPOSURE")).withColumn("severity", F.lit("P0"))
        .withColumn("confidence", F.lit(0.9)).withColumn("status", F.lit("UNREVIEWED"))
    )
