"""Queries over review findings and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions import dims, text
from gitstrata.operators import callgraph as K
from gitstrata.operators import findings as N
from gitstrata.operators import reports as R
from gitstrata.operators import search as Q
from gitstrata.operators import verify as V
from gitstrata.plans.registry import query, quoted, sql_any_match, sql_groups, sql_mask, sql_severity
from gitstrata.sources import sinks

KEY = ["repo_id", "file", "start_line", "end_line", "category"]
DOUBT = " OR ".join(f"contains(r.reason, {quoted(w)})" for w in dims.DOUBT_WORDS)
CODE = (
    "CASE " + " ".join(f"WHEN upper(trim({{c}})) = '{c}' OR trim({{c}}) = {quoted(z)} THEN '{c}'" for c, z, _ in dims.FINDING_CATEGORIES)
    + " ELSE 'OTHER' END"
)
CATEGORY_TEXT = sql_groups("lower({c})", dims.CATEGORY_WORDS, "contains", "'OTHER'")
SEVERITY_TEXT = sql_groups("lower({c})", dims.SEVERITY_WORDS, "contains", "'P4'")


def code(c: str) -> str:
    return CODE.replace("{c}", c)


def category_text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'OTHER' ELSE {CATEGORY_TEXT.replace('{c}', c)} END"


def severity_text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'P4' ELSE {SEVERITY_TEXT.replace('{c}', c)} END"


# ---- replies to findings

JSON_OF = r"regexp_extract(body, '(?s)```[^\n]*\n(.*?)```', 1)"


@query("isolate_json", f"SELECT response_id, trim({JSON_OF}, chr(10) || ' ') AS json FROM responses")
def _(src):
    return src.responses.select("response_id", N.isolate_json(F.col("body")).alias("json"))


def broken(src):
    """Replies whose content holds raw quotes and line breaks."""
    fixed = F.replace("body", F.lit("possible null value"), F.lit('a "null" value\nhere'))
    return src.responses.withColumn("body", fixed)


@query("repair_json", """SELECT response_id, path, 'a "null" value' || chr(10) || 'here' AS content, start_line, false AS rejected FROM responses""")
def _(src):
    rows = N.parse_replies(broken(src), N.COMMENT_SCHEMA)
    c = F.get("parsed.comments", 0)
    return rows.select("response_id", c["path"].alias("path"), c["content"].alias("content"), N.whole_number(c["startLine"]).alias("start_line"), "rejected")


@query("rejected_replies", "SELECT response_id FROM responses WHERE response_id % 7 = 3")
def _(src):
    cut_off = F.when(F.col("response_id") % 7 == 3, F.expr("replace(body, ']', '')")).otherwise(F.col("body"))
    return N.rejected(src.responses.select("response_id", cut_off.alias("body"))).select("response_id")


@query("comments_to_findings", """
SELECT response_id, path AS file, start_line, end_line, CASE WHEN toxic = 1 THEN 'SECURITY' ELSE 'NPE' END AS category,
  CASE WHEN toxic = 1 THEN 'P0' ELSE 'P1' END AS severity, CAST(0.73 AS DOUBLE) AS confidence, 'UNREVIEWED' AS status, 'possible null value' AS trigger_text FROM responses""")
def _(src):
    out = N.findings_from_comments(N.comments(src.responses.select("response_id", "body")))
    return out.select("response_id", "file", "start_line", "end_line", "category", "severity", "confidence", "status", "trigger_text")


def direct(src):
    """Replies that hold findings, with every other one under an alias name."""
    even = F.col("response_id") % 2 == 0
    doc = F.concat(
        F.lit('{"findings":[{"'), F.when(even, "file").otherwise("filePath"), F.lit('":"'), F.col("path"), F.lit('","'),
        F.when(even, "startLine").otherwise("line"), F.lit('":'), F.col("start_line"), F.lit(',"endLine":'), F.col("end_line"),
        F.lit(',"confidence":'), F.when(even, "0").otherwise("0.9"), F.when(even, "").otherwise(',"category":"NPE","severity":"HIGH"'),
        F.lit(',"evidence":"a --- b","trigger":"t"}]}'),
    )
    return src.responses.select("response_id", doc.alias("body"))


DIRECT = """SELECT response_id, path AS file, CASE WHEN start_line <= 0 THEN 1 ELSE start_line END AS start_line,
  CASE WHEN start_line <= 0 THEN 1 ELSE end_line END AS end_line, CASE WHEN response_id % 2 = 0 THEN 'OTHER' ELSE 'NPE' END AS category,
  CASE WHEN response_id % 2 = 0 THEN 'P2' ELSE 'P1' END AS severity, CAST(CASE WHEN response_id % 2 = 0 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence FROM responses"""


@query("direct_findings_ingest", DIRECT)
def _(src):
    return N.findings_from_json(direct(src)).select("response_id", "file", "start_line", "end_line", "category", "severity", "confidence")


@query("split_merged_findings", """
SELECT response_id, part, CASE WHEN part = 1 THEN 'a' ELSE 'b' END AS evidence, 't' AS trigger_text FROM responses, (SELECT unnest([1, 2]) AS part) p""")
def _(src):
    return N.split_merged(N.findings_from_json(direct(src))).select("response_id", "part", "evidence", "trigger_text")


@query("summary_to_finding", f"""
SELECT ord, {category_text('message')} AS category, CASE author_name WHEN 'src1' THEN 'P1' WHEN 'src2' THEN 'P2' ELSE 'P3' END AS severity, CAST(0.7 AS DOUBLE) AS confidence FROM messages""")
def _(src):
    risk = F.when(F.col("author_name") == "src1", " high").when(F.col("author_name") == "src2", "medium").otherwise("x")
    rows = src.messages.select("ord", F.col("message").alias("key_findings"), F.lit("i").alias("code_issues"), F.lit("c").alias("conclusion"), risk.alias("risk_level"))
    return N.finding_from_summary(rows).select("ord", "category", "severity", "confidence")


@query("bug_to_finding", f"SELECT repo_id, id, author_name AS owner, 1 AS start_line, CAST(1 + ord % 9 AS INT) AS end_line, 'LOGIC_ERROR' AS category, {severity_text('message')} AS severity FROM commits")
def _(src):
    bugs = src.commits.select(
        "repo_id", F.col("branch").alias("path"), F.col("author_name").alias("author"), "message", F.lit("m").alias("fixed_message"),
        F.lit("f").alias("fixed_by"), F.col("created_at").alias("fixed_at"), F.col("id").alias("commit_id"), (F.col("ord") % 9 + 1).alias("line_count"),
    )
    out = N.finding_from_bug(bugs)
    return out.select("repo_id", F.get("blame_commit_ids", 0).alias("id"), "owner", "start_line", "end_line", "category", "severity")


@query("category_from_text", f"SELECT ord, {category_text('message')} AS category FROM messages")
def _(src):
    return src.messages.select("ord", text.category_from_text(F.col("message")).alias("category"))


@query("category_from_code", f"SELECT ord, {code('category')} AS category FROM reviews")
def _(src):
    return src.reviews.select("ord", F.coalesce(text.category_from_code(F.col("category")), F.lit("OTHER")).alias("category"))


@query("severity_from_text", f"SELECT ord, {severity_text('message')} AS severity FROM messages")
def _(src):
    return src.messages.select("ord", text.severity_from_text(F.col("message")).alias("severity"))


@query("severity_from_category", f"SELECT ord, {sql_severity('category')} AS severity FROM findings")
def _(src):
    return src.findings.select("ord", text.severity_from_category(F.col("category")).alias("severity"))


@query("severity_from_level", "SELECT ord, CASE WHEN lower(severity) IN ('p0', 'p1', 'p2', 'p3') THEN severity ELSE 'P4' END AS severity FROM findings")
def _(src):
    return src.findings.select("ord", text.severity_from_level(F.lower("severity")).alias("severity"))


# ---- deduplication

EXACT = "(SELECT * FROM findings_small QUALIFY row_number() OVER (PARTITION BY repo_id, file, start_line, end_line, category ORDER BY coalesce(length(evidence), -1) DESC, ord) = 1)"


@query("dedupe_exact", f"SELECT repo_id, file, start_line, end_line, category, evidence, ord FROM {EXACT}")
def _(src):
    return N.dedupe_exact(src.findings_small).select(*KEY, "evidence", "ord")


@query("dedupe_line_buckets", """
SELECT repo_id, file, start_line, end_line, category, ord FROM findings_small QUALIFY row_number() OVER (PARTITION BY repo_id, file, start_line // 3, category ORDER BY ord) = 1""")
def _(src):
    return N.dedupe_buckets(src.findings_small).select(*KEY, "ord")


def merged_sql(source: str) -> str:
    fold = lambda c: (
        f"list_reduce(list({c} ORDER BY start_line, ord) FILTER ({c} IS NOT NULL AND {c} <> ''), lambda a, b: "
        "CASE WHEN contains(a, b) THEN a WHEN contains(b, a) THEN b ELSE a || chr(10) || '---' || chr(10) || b END)"
    )
    safe = lambda c: f"CASE WHEN count({c}) FILTER ({c} <> '') > 0 THEN {fold(c)} END AS {c}"
    return f"""(SELECT repo_id, file, min(start_line) AS start_line, max(end_line) AS end_line, min(severity) AS severity, max(confidence) AS confidence,
  arg_max(category, (confidence, -start_line, -ord)) AS category,
  CASE WHEN bool_or(status = 'CONFIRMED') THEN 'CONFIRMED' WHEN bool_or(status = 'FALSE_POSITIVE') THEN 'FALSE_POSITIVE' ELSE 'UNREVIEWED' END AS status,
  min(ord) AS ord, count(*) AS merged_count, arg_min(module_name, (start_line, ord)) AS module_name,
  {safe('evidence')}, {safe('trigger_text')}, {safe('candidate_handler')}, {safe('owner')}, {safe('symbol')}
FROM (SELECT *, sum(opens) OVER (PARTITION BY repo_id, file ORDER BY start_line, ord) AS island FROM
  (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY repo_id, file ORDER BY start_line, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source} s) t) u
GROUP BY repo_id, file, island)"""


MERGED = ["repo_id", "file", "start_line", "end_line", "severity", "confidence", "category", "status", "ord", "merged_count",
          "module_name", "evidence", "trigger_text", "candidate_handler", "owner", "symbol"]


# A column of blanks is text too: '' is the only value the merge skips.
@query("merge_overlaps", f"SELECT * FROM {merged_sql('findings')}")
def _(src):
    return N.merge_overlaps(src.findings).select(*MERGED)


@query("merge_overlaps_dense", f"SELECT * FROM {merged_sql('findings_small')}")
def _(src):
    return N.merge_overlaps(src.findings_small).select(*MERGED)


# ---- ownership

LASTS = "(SELECT repo_id, path, max_by(author_name, line_no) AS author_name FROM blame_lines WHERE author_name IS NOT NULL GROUP BY ALL)"


def lasts(src):
    named = src.blame_lines.where("author_name IS NOT NULL")
    return named.groupBy("repo_id", "path").agg(F.max_by("author_name", "line_no").alias("author_name"))


def traced_sql(source: str) -> str:
    return f"""(SELECT s.* REPLACE (coalesce(h.who, s.candidate_handler) AS candidate_handler, coalesce(h.who, s.owner) AS owner) FROM {source} s LEFT JOIN
 (SELECT f.ord, coalesce(min_by(b.author_name, b.line_no), any_value(l.author_name)) AS who FROM {source} f
  LEFT JOIN blame_lines b ON b.repo_id = f.repo_id AND b.path = f.file AND b.author_name IS NOT NULL AND b.line_no BETWEEN f.start_line AND greatest(f.start_line, f.end_line)
  LEFT JOIN {LASTS} l ON l.repo_id = f.repo_id AND l.path = f.file WHERE f.severity IN ('P0', 'P1', 'P2') GROUP BY f.ord) h ON h.ord = s.ord)"""


@query("blame_owner", f"SELECT ord, candidate_handler, owner FROM {traced_sql('findings_small')}")
def _(src):
    return N.trace_owner(src.findings_small, src.blame_lines, lasts(src)).select("ord", "candidate_handler", "owner")


@query("blame_owner_wide_lines", f"SELECT ord, candidate_handler, owner FROM {traced_sql('findings')}")
def _(src):
    return N.trace_owner(src.findings, src.blame_lines, lasts(src)).select("ord", "candidate_handler", "owner")


SHARES = """(SELECT *, lines / sum(lines) OVER (PARTITION BY repo_id, file, start_line, end_line) AS share FROM
 (SELECT f.repo_id, f.file, f.start_line, f.end_line, b.author_name, count(*) AS lines FROM (SELECT DISTINCT repo_id, file, start_line, end_line FROM findings_small) f
  JOIN blame_lines b ON b.repo_id = f.repo_id AND b.path = f.file AND b.author_name IS NOT NULL AND b.line_no BETWEEN f.start_line AND f.end_line GROUP BY ALL))"""


@query("blame_shares", f"SELECT repo_id, file, start_line, end_line, author_name, lines, share FROM {SHARES}")
def _(src):
    return N.owner_shares(src.findings_small, src.blame_lines)


@query("blame_share_text", f"""
SELECT repo_id, file, start_line, end_line, string_agg(author_name || '(' || CAST(CAST(floor(share * 100 + 0.5) AS INT) AS STRING) || '%)', ', ' ORDER BY lines DESC, author_name) AS owner FROM {SHARES} GROUP BY ALL""")
def _(src):
    return N.owner_text(N.owner_shares(src.findings_small, src.blame_lines))


# ---- cross review, secrets

def reviewed_sql(source: str) -> str:
    conf = f"CASE WHEN {DOUBT} THEN least(m, 0.7) ELSE m END"
    return f"""(SELECT * EXCLUDE (m, r_conf, r_cat, reason, r_trig, r_fix, is_on)
 REPLACE (CASE WHEN is_on THEN conf ELSE confidence END AS confidence, CASE WHEN is_on THEN CASE WHEN conf >= 0.7 THEN 'CONFIRMED' ELSE 'FALSE_POSITIVE' END ELSE status END AS status,
  CASE WHEN is_on THEN cat ELSE category END AS category, CASE WHEN is_on AND cat <> 'OTHER' THEN {sql_severity('cat')} ELSE severity END AS severity,
  CASE WHEN is_on AND coalesce(trigger_text, '') = '' AND coalesce(r_trig, '') <> '' THEN r_trig ELSE trigger_text END AS trigger_text,
  CASE WHEN is_on AND coalesce(suggested_fix, '') = '' AND coalesce(r_fix, '') <> '' THEN r_fix ELSE suggested_fix END AS suggested_fix),
  CASE WHEN is_on THEN reason END AS conclusion
FROM (SELECT *, {conf.replace('r.reason', 'reason')} AS conf, CASE WHEN {code('r_cat')} <> 'OTHER' THEN {code('r_cat')} ELSE category END AS cat FROM
 (SELECT f.*, (f.confidence + least(greatest(r.confidence, 0), 1)) / 2 AS m, r.confidence AS r_conf, r.category AS r_cat, r.reason, r.trigger_text AS r_trig, r.suggested_fix AS r_fix,
   r.ord IS NOT NULL AND f.severity IN ('P0', 'P1', 'P2') AS is_on FROM {source} f LEFT JOIN reviews r ON r.ord = f.ord)))"""


REVIEWED = ["ord", "confidence", "status", "category", "severity", "trigger_text", "suggested_fix", "conclusion"]


@query("cross_review_apply", f"SELECT {', '.join(REVIEWED)} FROM {reviewed_sql('findings')}")
def _(src):
    return N.apply_reviews(src.findings, src.reviews).select(*REVIEWED)


@query("status_from_confidence", "SELECT ord, CASE WHEN confidence >= 0.7 THEN 'CONFIRMED' ELSE 'FALSE_POSITIVE' END AS status FROM findings")
def _(src):
    return src.findings.select("ord", text.status_from_confidence(F.col("confidence")).alias("status"))


@query("mask_secrets", f"SELECT ord, {sql_mask('evidence')} AS evidence, {sql_mask('trigger_text')} AS trigger_text FROM findings")
def _(src):
    return N.mask_findings(src.findings).select("ord", "evidence", "trigger_text")


@query("mask_secrets_long_text", f"SELECT ord, {sql_mask('message')} AS message FROM messages")
def _(src):
    return src.messages.select("ord", text.mask_secrets(F.col("message")).alias("message"))


PATTERNS = [p for p, _ in dims.SECRET_PATTERNS]


@query("detect_secrets", f"""
SELECT ord, file, {sql_mask('evidence')} AS evidence, 'SECRET_EXPOSURE' AS category, 'P0' AS severity FROM findings
WHERE ({sql_any_match('evidence', PATTERNS)} OR {sql_any_match('trigger_text', PATTERNS)} OR {sql_any_match('suggested_fix', PATTERNS)}) AND category <> 'SECRET_EXPOSURE'""")
def _(src):
    return N.secret_findings(src.findings).select("ord", "file", "evidence", "category", "severity")


LOG = "message"
for _p in dims.LOG_PATTERNS:
    LOG = f"regexp_replace({LOG}, {quoted(_p)}, '\\1******', 'g')"


@query("mask_log_text", f"SELECT ord, {LOG} AS message FROM messages")
def _(src):
    return src.messages.select("ord", text.mask_log(F.col("message")).alias("message"))


# ---- verification

def hits_sql(source: str) -> str:
    return f"""(SELECT f.ord, min(l.n) AS hit FROM {source} f JOIN (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM sources) l
 ON l.repo_id = f.repo_id AND l.path = f.file AND length(trim(f.evidence)) > 5 AND contains(l.line, trim(f.evidence)) GROUP BY f.ord)"""


HITS = hits_sql("findings_small")


@query("evidence_locate", f"SELECT f.ord, h.hit AS hit_line FROM findings_small f JOIN {HITS} h ON h.ord = f.ord")
def _(src):
    f = src.findings_small
    hits = V.locate_evidence(f, src.sources)
    keyed = f.withColumn("key", V.evidence_key(F.col("evidence")))
    return keyed.join(hits, ["repo_id", "file", "key"]).select("ord", "hit_line")


def checked_sql(source: str, hits: str = HITS) -> str:
    return f"""(SELECT * EXCLUDE (hit, total) REPLACE (
  CAST(CASE WHEN hit IS NOT NULL AND (start_line > total OR abs(hit - start_line) > 10) THEN hit WHEN start_line > total THEN 1 ELSE start_line END AS INT) AS start_line,
  CAST(CASE WHEN hit IS NOT NULL AND (start_line > total OR abs(hit - start_line) > 10) THEN hit + end_line - start_line WHEN start_line > total THEN 1 ELSE end_line END AS INT) AS end_line)
 FROM (SELECT f.*, h.hit, len(string_split(s.content, chr(10))) AS total FROM {source} f LEFT JOIN {hits} h ON h.ord = f.ord LEFT JOIN sources s ON s.repo_id = f.repo_id AND s.path = f.file))"""


@query("line_check", f"SELECT ord, start_line, end_line FROM {checked_sql('findings_small')}")
def _(src):
    return V.check_lines(src.findings_small, src.sources).select("ord", "start_line", "end_line")


@query("reject_compile_errors", "SELECT ord, category FROM findings WHERE category <> 'COMPILE_ERROR'")
def _(src):
    return V.reject_compile_errors(src.findings).select("ord", "category")


GUARD = f"({sql_any_match('evidence', dims.GUARD_PATTERNS)} AND confidence < 0.8)"


@query("guard_false_positive", f"""
SELECT ord, CASE WHEN {GUARD} THEN 'P3' ELSE severity END AS severity, CASE WHEN {GUARD} THEN 'FALSE_POSITIVE' ELSE status END AS status FROM findings""")
def _(src):
    return V.guarded_false_positives(src.findings).select("ord", "severity", "status")


@query("missing_trigger", "SELECT ord, CASE WHEN severity IN ('P0', 'P1') AND trim(coalesce(trigger_text, '')) = '' THEN 'P2' ELSE severity END AS severity FROM findings")
def _(src):
    return V.missing_triggers(src.findings).select("ord", "severity")


# symbol is "<class>.m<k>": candidates are functions named m<k>, the first by ending wins.
RESOLVED = """(SELECT r.repo_id, r.symbol, arg_min(s.qualified_name, (CASE WHEN s.qualified_name LIKE '%' || r.symbol THEN 0 ELSE 1 END, s.c)) AS target FROM
 (SELECT DISTINCT repo_id, symbol, regexp_replace(symbol, '[.][^.]*$', '') AS cls, split_part(symbol, '.', -1) AS method FROM findings) r
 JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY ord) AS c FROM symbols WHERE kind = 'Function') s
  ON s.repo_id = r.repo_id AND s.name = r.method
 WHERE s.qualified_name LIKE '%' || r.symbol OR (contains(s.qualified_name, '.' || r.method) AND (contains(s.file, r.cls) OR contains(s.qualified_name, r.cls))) GROUP BY 1, 2)"""
CALLERS = """(SELECT e.repo_id, e.target, count(*) AS callers, bool_or(coalesce(s.annotation = 'Transactional', false)) AS tx FROM call_edges e
 LEFT JOIN symbols s ON s.repo_id = e.repo_id AND s.qualified_name = e.source GROUP BY 1, 2)"""


def symbols(src):
    return src.symbols.withColumn("annotations", F.array_compact(F.array("annotation")))


def call_facts(src):
    return K.resolve_symbols(src.symbols, src.findings), K.caller_facts(src.call_edges, symbols(src))


FACTOR = """CASE WHEN c.target IS NOT NULL AND f.category = 'TRANSACTION' AND coalesce(k.tx, false) THEN 0.75
  WHEN c.target IS NOT NULL AND f.category = 'RESOURCE_LEAK' AND k.callers IS NULL THEN 0.7 ELSE 1.0 END"""


@query("call_graph_check", f"""
SELECT f.ord, f.confidence * {FACTOR} AS confidence FROM findings f LEFT JOIN {RESOLVED} c ON c.repo_id = f.repo_id AND c.symbol = f.symbol
LEFT JOIN {CALLERS} k ON k.repo_id = c.repo_id AND k.target = c.target""")
def _(src):
    return V.check_calls(src.findings, *call_facts(src)).select("ord", "confidence")


def outcome_sql(source: str) -> str:
    return f"""(SELECT * EXCLUDE (guarded, bare, factor) REPLACE (
   CASE WHEN bare_after THEN 'P2' WHEN guarded THEN 'P3' ELSE severity END AS severity, CASE WHEN guarded THEN 'FALSE_POSITIVE' ELSE status END AS status,
   CASE WHEN guarded OR bare_after THEN confidence ELSE confidence * factor END AS confidence),
  CASE WHEN category = 'COMPILE_ERROR' THEN 'rejected' WHEN guarded OR bare_after OR factor < 1 THEN 'downgraded' ELSE 'accepted' END AS outcome
 FROM (SELECT *, bare AND NOT guarded AS bare_after FROM (SELECT f.*, {GUARD.replace('evidence', 'f.evidence').replace('confidence', 'f.confidence')} AS guarded,
   f.severity IN ('P0', 'P1') AND trim(coalesce(f.trigger_text, '')) = '' AS bare, {FACTOR} AS factor
  FROM {source} f LEFT JOIN {RESOLVED} c ON c.repo_id = f.repo_id AND c.symbol = f.symbol LEFT JOIN {CALLERS} k ON k.repo_id = c.repo_id AND k.target = c.target)))"""


@query("verify_outcome", f"SELECT ord, severity, status, confidence, outcome FROM {outcome_sql('findings')}")
def _(src):
    return V.outcomes(src.findings, *call_facts(src)).select("ord", "severity", "status", "confidence", "outcome")


CHAIN = ["repo_id", "file", "start_line", "end_line", "severity", "category", "status", "confidence", "outcome", "owner"]
SECRET_ANY = " OR ".join(sql_any_match(c, PATTERNS) for c in N.SECRET_FIELDS)


# The steps of the chain; what each gives is a query of its own too.
STEPS = f"""
WITH s1 AS MATERIALIZED (SELECT * FROM {EXACT}), s2 AS MATERIALIZED (SELECT * FROM {traced_sql('s1')}), s3 AS MATERIALIZED (SELECT * FROM {reviewed_sql('s2')}),
s4 AS MATERIALIZED (SELECT * REPLACE ({', '.join(f"{sql_mask(c)} AS {c}" for c in N.SECRET_FIELDS)}) FROM s3),
s5h AS MATERIALIZED (SELECT * FROM {hits_sql("s4")}), s5 AS MATERIALIZED (SELECT * FROM {checked_sql("s4", "s5h")}),
s6 AS MATERIALIZED (SELECT * FROM {merged_sql("s5")}), resolved AS MATERIALIZED (SELECT * FROM {RESOLVED}), callers AS MATERIALIZED (SELECT * FROM {CALLERS}),
s7 AS MATERIALIZED (SELECT * FROM {outcome_sql('s6').replace(RESOLVED, 'resolved').replace(CALLERS, 'callers')})
"""
SECRETS = f"""SELECT repo_id, file, start_line, end_line, 'P0' AS severity, 'SECRET_EXPOSURE' AS category, 'UNREVIEWED' AS status, CAST(0.9 AS DOUBLE) AS confidence,
  'secret' AS outcome, owner FROM s3 WHERE ({SECRET_ANY}) AND coalesce(category, '') <> 'SECRET_EXPOSURE'"""


def through(step: str) -> str:
    """SQL of the steps up to ``step``."""
    return STEPS[:STEPS.index(f"{step} AS MATERIALIZED (")].rstrip().rstrip(",")


def chain_parts(src):
    return V.review_steps(src.findings_small, src.blame_lines, lasts(src), src.reviews, src.sources)


@query("review_chain_reviewed", through("s4") + " SELECT ord, severity, category, status, confidence, owner FROM s3", once=True)
def _(src):
    return chain_parts(src)[0].select("ord", "severity", "category", "status", "confidence", "owner")


@query("review_chain_merged", through("resolved") + " SELECT repo_id, file, start_line, end_line, severity, category, status, confidence, owner FROM s6", once=True)
def _(src):
    return chain_parts(src)[1].select(*[c for c in CHAIN if c != "outcome"])


@query("review_chain", f"{STEPS} SELECT {', '.join(CHAIN)} FROM s7 WHERE outcome <> 'rejected' UNION ALL SELECT {', '.join(CHAIN)} FROM ({SECRETS})", once=True)
def _(src):
    out = V.review_chain(src.findings_small, src.blame_lines, lasts(src), src.reviews, src.sources, *call_facts(src))
    return out.select(*CHAIN)


P = lambda s: f"count(*) FILTER (severity = '{s}')"


@query("review_totals", f"""
SELECT repo_id, count(*) AS findings, {P('P0')} AS p0, {P('P1')} AS p1, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(DISTINCT module_name) AS modules,
  CASE WHEN {P('P0')} > 0 THEN 'must change' ELSE 'should change' END AS conclusion,
  CASE WHEN {P('P0')} > 0 OR {P('P1')} >= 3 THEN 'high' WHEN {P('P1')} > 0 THEN 'medium' ELSE 'low' END AS risk FROM findings GROUP BY repo_id""")
def _(src):
    return V.review_totals(src.findings)


@query("section_parse", """
SELECT ord, trim(message, ' ' || chr(10) || chr(9)) AS change_summary, '需修改' AS conclusion, '中' AS risk_level, author_name AS key_findings FROM messages""")
def _(src):
    body = F.concat(
        F.lit("前言\n### 1. 代码变更说明\n"), F.col("message"), F.lit("\n### 6. 审查结论\n**结论**: **需修改**\n风险等级: 中\n**关键发现**: "), F.col("author_name")
    )
    out = V.parse_sections(src.messages.select("ord", body.alias("body")))
    return out.select("ord", "change_summary", "conclusion", "risk_level", "key_findings")


# ---- evidence windows

@query("evidence_window", """
SELECT f.ord, coalesce(w.window, f.evidence) AS "window" FROM findings_small f LEFT JOIN
 (SELECT g.start_line, g.end_line, g.repo_id, g.file, string_agg(CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, ' ') ELSE CAST(n AS STRING) END || ' | ' || line, chr(10) ORDER BY n) AS "window"
  FROM (SELECT DISTINCT repo_id, file, start_line, end_line FROM findings_small) g
  JOIN (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM sources) l
  ON l.repo_id = g.repo_id AND l.path = g.file AND l.n BETWEEN g.start_line - 30 AND g.end_line + 30 GROUP BY ALL) w
 ON w.repo_id = f.repo_id AND w.file = f.file AND w.start_line = f.start_line AND w.end_line = f.end_line""")
def _(src):
    return Q.evidence_windows(src.findings_small, src.sources).select("ord", "window")


# ---- report tables

OK = "(status <> 'FALSE_POSITIVE' AND confidence >= 0.7)"


def day():
    return F.lit("2024-03-07").cast("timestamp")


@query("confirmed_set", f"SELECT ord, severity FROM findings WHERE {OK}")
def _(src):
    return R.confirmed(src.findings).select("ord", "severity")


@query("severity_counts", f"""SELECT repo_id, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}_all, count(*) FILTER (severity = '{s}' AND {OK}) AS {s.lower()}_confirmed" for s in ('P0', 'P1', 'P2'))} FROM findings GROUP BY repo_id""")
def _(src):
    return R.severity_counts(src.findings)


@query("scope_facts", """
SELECT repo_id, commits, authors, files FROM (SELECT repo_id, count(*) AS commits, count(DISTINCT author_name) AS authors FROM commits GROUP BY 1) c
FULL JOIN (SELECT repo_id, count(DISTINCT path) AS files FROM diffs GROUP BY 1) d USING (repo_id)""")
def _(src):
    return R.scope_facts(src.commits, src.diffs)


def risky(src):
    """One report per file, so that small counts occur."""
    return src.findings.withColumn("repo_id", F.concat_ws(":", "repo_id", "file"))


RISKY = "(SELECT repo_id || ':' || file AS repo_id, severity, status, confidence FROM findings)"
C0, C1 = f"count(*) FILTER (severity = 'P0' AND {OK})", f"count(*) FILTER (severity = 'P1' AND {OK})"


@query("risk_level", f"""SELECT repo_id, {C0} AS p0_confirmed, {C1} AS p1_confirmed,
 CASE WHEN {C0} >= 3 THEN 'severe' WHEN {C0} >= 1 OR {C1} >= 5 THEN 'high' WHEN {C1} >= 1 THEN 'medium' ELSE 'low' END AS risk FROM {RISKY} GROUP BY 1""")
def _(src):
    return R.risk_level(risky(src)).drop("release")


@query("release_advice", f"""SELECT repo_id, CASE WHEN {C0} > 0 THEN 'no' WHEN {C1} >= 3 THEN 'after fix' WHEN {C1} >= 1 THEN 'conditional' ELSE 'yes' END AS release FROM {RISKY} GROUP BY 1""")
def _(src):
    return R.risk_level(risky(src)).select("repo_id", "release")


# Working days after a Thursday: 3 -> Tuesday, 7 -> Monday of the week after next.
DUE = "CASE severity WHEN 'P0' THEN 'immediate' WHEN 'P1' THEN '2024-03-12' WHEN 'P2' THEN '2024-03-18' ELSE '-' END"


@query("handler_tasks", f"""
SELECT repo_id, handler, CAST(sum(n) AS BIGINT) AS n, CASE WHEN bool_or(due = 'immediate') THEN 'immediate' ELSE coalesce(min(nullif(due, '-')), '-') END AS earliest,
 string_agg(severity || '×' || n, ' ' ORDER BY severity) AS mix
FROM (SELECT repo_id, coalesce(nullif(candidate_handler, ''), 'unassigned') AS handler, severity, {DUE} AS due, count(*) AS n FROM findings WHERE {OK} GROUP BY ALL) GROUP BY ALL""")
def _(src):
    return R.handler_tasks(src.findings, day())




@query("working_day_deadline", """
WITH days AS (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM commits),
ahead AS (SELECT day, d, row_number() OVER (PARTITION BY day ORDER BY d) AS k FROM (SELECT day, unnest(range(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, CAST(day AS TIMESTAMP) + INTERVAL 13 DAY, INTERVAL 1 DAY)) AS d FROM days) x WHERE isodow(d) < 6)
SELECT c.id, CASE c.ord % 4 WHEN 0 THEN 'immediate' WHEN 3 THEN '-' ELSE strftime(a.d, '%Y-%m-%d') END AS deadline FROM commits c
JOIN ahead a ON a.day = CAST(c.created_at AS DATE) AND a.k = CASE WHEN c.ord % 4 = 1 THEN 3 ELSE 7 END""")
def _(src):
    severity = F.concat(F.lit("P"), F.col("ord") % 4)
    return src.commits.select("id", R.deadline(severity, F.col("created_at")).alias("deadline"))


@query("disposition_order", """
SELECT repo_id, ord, severity, row_number() OVER (PARTITION BY repo_id, severity ORDER BY file, start_line, ord) AS idx, count(*) OVER (PARTITION BY repo_id, severity) AS section_size FROM findings""")
def _(src):
    return R.disposition(src.findings).select("repo_id", "ord", "severity", "idx", "section_size")


@query("code_link", """
SELECT ord, 'https://' || CASE WHEN ord % 2 = 0 THEN 'github.com/acme/' || repo_id || '/blob/' ELSE 'git.acme.org/acme/' || repo_id || '/-/blob/' END || 'main/' || file || '#L' || start_line
 || CASE WHEN end_line > start_line THEN '-L' || end_line ELSE '' END AS link FROM findings""")
def _(src):
    remote = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://GitHub.com/acme/"), "repo_id", F.lit(".git"))).otherwise(
        F.concat(F.lit("git@git.acme.org:acme/"), "repo_id", F.lit(".git"))
    )
    link = R.code_link(remote, F.lit("main"), F.col("file"), F.col("end_line"), F.col("start_line"))
    return src.findings.select("ord", link.alias("link"))


@query("module_risk", """
SELECT repo_id, module_name AS module, count(DISTINCT file) AS files, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, count(*) FILTER (severity = 'P2') AS p2,
 count(*) FILTER (severity = 'P3') AS p3, count(*) FILTER (severity = 'P4') AS p4, CAST(sum(CASE severity WHEN 'P0' THEN 10 WHEN 'P1' THEN 5 WHEN 'P2' THEN 2 WHEN 'P3' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM findings GROUP BY ALL""")
def _(src):
    return R.module_risk(src.findings)


@query("repeated_patterns", """
SELECT repo_id, category, CAST(sum(n) AS BIGINT) AS n, string_agg(module_name || '(' || n || ')', ', ' ORDER BY n DESC, module_name) AS modules,
 coalesce(trim(arg_min(ex, o)), '-') AS example FROM (SELECT repo_id, category, module_name, count(*) AS n, min(ord) FILTER (trigger_text <> '') AS o, arg_min(trigger_text, ord) FILTER (trigger_text <> '') AS ex FROM findings GROUP BY ALL)
GROUP BY ALL HAVING sum(n) >= 2""")
def _(src):
    return R.repeated_patterns(src.findings)


@query("comments_by_file", """
SELECT repo_id, file AS path, ord, row_number() OVER (PARTITION BY repo_id, file ORDER BY ord) AS idx, count(*) OVER (PARTITION BY repo_id, file) AS file_comments FROM findings""")
def _(src):
    rows = src.findings.select("repo_id", F.col("file").alias("path"), "ord")
    return R.comments_by_file(rows)


@query("display_truncation", """
SELECT ord, CASE WHEN length(trim(replace(coalesce(trigger_text, ''), chr(10), ' '))) > 40 THEN left(trim(replace(trigger_text, chr(10), ' ')), 40) || '...' ELSE trim(replace(coalesce(trigger_text, ''), chr(10), ' ')) END AS text_cell,
 CASE WHEN length(file) > 40 THEN '...' || right(file, 37) ELSE file END AS path_cell FROM findings""")
def _(src):
    return R.display_cells(src.findings)


@query("short_commit_ids", "SELECT repo_id, branch, string_agg(left(id, 8), '; ' ORDER BY id) AS ids FROM (SELECT DISTINCT repo_id, branch, id FROM commits) GROUP BY ALL")
def _(src):
    joined = F.array_join(F.array_sort(F.collect_set(F.concat("id", F.lit("ffff")))), "; ")
    per = src.commits.groupBy("repo_id", "branch").agg(joined.alias("ids"))
    return per.select("repo_id", "branch", R.short_ids(F.col("ids")).alias("ids"))


@query("report_module_page", """
SELECT repo_id, '| ' || module_name || ' | ' || count(DISTINCT file) || ' |' AS line FROM findings GROUP BY repo_id, module_name""")
def _(src):
    page = sinks.report_tables(src.findings, day())["modules"]
    return sinks.markdown_rows(page, ["module", "files"], [F.col("repo_id"), F.col("score").desc()])
