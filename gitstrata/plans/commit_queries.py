"""Queries over commits: sources, cleaning, classes, contributors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions import dims
from gitstrata.operators import commits as C
from gitstrata.operators import contributors as D
from gitstrata.plans.registry import query, quoted, sql_clean, sql_groups, sql_rule_category
from gitstrata.sources import commits as S
from gitstrata.sources import history, snapshots

COLS = "repo_id, id, author_name, message, created_at, ord"
RULED = f"(SELECT *, {sql_rule_category('message')} AS category FROM commits)"
AUTHOR = "coalesce(author_name, 'unknown')"


def parents(df):
    return df.withColumn("parent_ids", F.array_compact(F.array("parent1", "parent2")))


def classed(src):
    return C.classify(src.commits)


def cols(df):
    return df.select(*[c.strip() for c in COLS.split(",")])


# ---- sources

@query("commits_source", "SELECT ord, trim(split_part(message, chr(10), 1)) AS message, author_name FROM messages")
def _(src):
    return S.commits_from_log(src.messages).select("ord", "message", "author_name")


@query("drop_merges_by_parents", f"SELECT {COLS} FROM commits WHERE parent2 IS NULL")
def _(src):
    return cols(S.drop_merges(parents(src.commits)))


@query("drop_merges_by_message", "SELECT ord, length(message) AS n FROM messages WHERE NOT starts_with(message, 'Merge')")
def _(src):
    return S.drop_merges(src.messages, by="message").select("ord", F.length("message").alias("n"))


@query("time_window", f"SELECT {COLS} FROM commits WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def _(src):
    return cols(S.time_window(src.commits, "1996-01-01", "1997-12-31"))


RANGES = """
SELECT repo_id, CASE WHEN repo_id = 'repo3' THEN 'nowhere' ELSE lo END AS since,
  CASE WHEN repo_id = 'repo2' THEN 'nowhere' ELSE hi END AS until, tip
FROM (SELECT repo_id, MAX(id) AS tip, LPAD(CAST(CAST(MAX(ord) AS BIGINT) - CAST(MAX(ord) AS BIGINT) % 40 + MAX(ord % 4) - 40 AS STRING), 8, '0') AS hi,
  LPAD(CAST(200 + MAX(ord % 4) AS STRING), 8, '0') AS lo FROM commits GROUP BY repo_id) t
"""


@query("hash_range_reachable", f"""
WITH RECURSIVE ranges AS ({RANGES}),
ends AS (SELECT r.repo_id, s.id AS since, CASE WHEN s.id IS NOT NULL AND u.id IS NOT NULL THEN u.id ELSE r.tip END AS until
  FROM ranges r LEFT JOIN commits s ON s.repo_id = r.repo_id AND s.id = r.since LEFT JOIN commits u ON u.repo_id = r.repo_id AND u.id = r.until),
links AS (SELECT repo_id, id, parent1 AS p FROM commits WHERE parent1 IS NOT NULL UNION ALL SELECT repo_id, id, parent2 FROM commits WHERE parent2 IS NOT NULL),
inside AS (SELECT repo_id, until AS id FROM ends UNION SELECT l.repo_id, l.p FROM inside i JOIN links l ON l.repo_id = i.repo_id AND l.id = i.id),
outside AS (SELECT repo_id, since AS id FROM ends WHERE since IS NOT NULL UNION SELECT l.repo_id, l.p FROM outside i JOIN links l ON l.repo_id = i.repo_id AND l.id = i.id)
SELECT repo_id, id, ord FROM commits c WHERE EXISTS (SELECT 1 FROM inside i WHERE i.repo_id = c.repo_id AND i.id = c.id)
  AND NOT EXISTS (SELECT 1 FROM outside i WHERE i.repo_id = c.repo_id AND i.id = c.id)""")
def _(src):
    return S.hash_range(parents(src.commits), src.sql(RANGES)).select("repo_id", "id", "ord")


POSITIONS = """
SELECT repo_id, CASE WHEN repo_id = 'repo3' THEN NULL ELSE MIN(id) END AS since, MAX(id) AS until FROM commits GROUP BY repo_id
"""


@query("hash_range_positional", f"""
WITH r AS ({POSITIONS}), p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, ord DESC) AS pos FROM commits),
e AS (SELECT r.repo_id, s.pos AS sp, u.pos AS up, r.since IS NOT NULL AND r.until IS NOT NULL AS ranged FROM r
  LEFT JOIN p s ON s.repo_id = r.repo_id AND s.id = r.since LEFT JOIN p u ON u.repo_id = r.repo_id AND u.id = r.until)
SELECT p.repo_id, p.id, p.ord FROM p JOIN e ON e.repo_id = p.repo_id WHERE NOT ranged OR (p.pos >= up AND (sp IS NULL OR p.pos < sp))""")
def _(src):
    return S.hash_range_by_position(parents(src.commits), src.sql(POSITIONS)).select("repo_id", "id", "ord")


@query("author_filter", f"SELECT {COLS} FROM commits WHERE author_name = 'dev0'")
def _(src):
    return cols(S.by_author(src.commits, "dev0"))


@query("newest_commits", f"SELECT {COLS} FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, ord DESC) <= 100")
def _(src):
    return cols(S.newest(src.commits, 100))


@query("author_directory", """
SELECT DISTINCT repo_id, author_name AS name, author_email AS email FROM
 (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id, branch ORDER BY created_at DESC, ord DESC) <= 500) t WHERE author_name IS NOT NULL""")
def _(src):
    return S.author_directory(src.commits, 500)


@query("branch_directory", "SELECT repo_id, replace(name, 'refs/remotes/origin/', '') AS name, commit_id FROM refs WHERE starts_with(name, 'refs/remotes/origin/')")
def _(src):
    return S.branch_directory(src.refs)


SNAP_OLD = "SELECT repo_id, path, module, content FROM sources WHERE module <> 'stock'"
SNAP_NEW = "SELECT repo_id, path, CASE WHEN module = 'user' THEN CONCAT(content, 'x') ELSE content END AS content FROM sources WHERE module <> 'auth'"


def snaps(src):
    s = src.sources
    old = s.where("module <> 'stock'").withColumn("content_hash", F.sha2("content", 256))
    new = s.where("module <> 'auth'").withColumn(
        "content", F.when(F.col("module") == "user", F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    ).withColumn("content_hash", F.sha2("content", 256))
    return old, new


@query("snapshot_diff", f"""
SELECT repo_id, path, CASE WHEN a.content IS NULL THEN 'ADD' WHEN b.content IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS change_type,
  a.content AS old_content, b.content AS new_content FROM ({SNAP_OLD}) a FULL JOIN ({SNAP_NEW}) b USING (repo_id, path)
WHERE a.content IS DISTINCT FROM b.content""")
def _(src):
    return snapshots.snapshot_diff(*snaps(src))


@query("root_commit", "SELECT repo_id, id, created_at FROM commits WHERE parent1 IS NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at, ord) = 1")
def _(src):
    return S.root_commits(parents(src.commits))


@query("fill_missing_content", f"""
WITH d AS (SELECT repo_id, path, b.content AS new_content FROM ({SNAP_OLD}) a FULL JOIN ({SNAP_NEW}) b USING (repo_id, path) WHERE a.content IS DISTINCT FROM b.content)
SELECT d.repo_id, d.path, coalesce(d.new_content, s.content, '') AS new_content FROM d LEFT JOIN sources s ON s.repo_id = d.repo_id AND s.path = d.path AND s.module <> 'report'""")
def _(src):
    diffs = snapshots.snapshot_diff(*snaps(src)).select("repo_id", "path", "new_content")
    return snapshots.fill_content(diffs, src.sources.where("module <> 'report'"))


TIMES = """SELECT ord, CASE WHEN ord % 4 = 0 THEN strftime(created_at, '%Y-%m-%d') WHEN ord % 4 = 1 THEN strftime(created_at, '%Y-%m-%dT%H:%M')
 WHEN ord % 4 = 2 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE 'on ' || strftime(created_at, '%Y') END AS t, created_at FROM commits"""


@query("lenient_time_parse", f"SELECT ord, t, CASE WHEN starts_with(t, 'on') THEN NULL ELSE created_at END AS at FROM ({TIMES})")
def _(src):
    at, kind = F.col("created_at"), F.col("ord") % 4
    t = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd")).when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("on "), F.date_format(at, "yyyy")))
    )
    return S.with_parsed_time(src.commits.select("ord", t.alias("t")), "t", "at")


@query("report_window", """
SELECT c.repo_id, c.branch, coalesce(t.updated_at, c.oldest) AS since, TIMESTAMP '2002-01-01' AS until
FROM (SELECT repo_id, branch, min(created_at) AS oldest FROM commits GROUP BY ALL) c
LEFT JOIN tracker t ON t.repo_id = c.repo_id AND t.branch = c.branch AND t.updated_at > TIMESTAMP '1996-01-01'""")
def _(src):
    marks = src.tracker.where("updated_at > TIMESTAMP '1996-01-01'")
    return S.report_window(src.commits, marks, F.lit("2002-01-01").cast("timestamp"))


@query("hash_defaults", """
SELECT repo_id, max_by(id, (created_at, ord)) AS until_hash, min_by(id, (created_at, ord)) AS since_hash,
  coalesce(arg_min_null(parent1, (created_at, ord)), min_by(id, (created_at, ord))) AS metrics_since_hash FROM commits GROUP BY repo_id""")
def _(src):
    return S.hash_defaults(parents(src.commits))


@query("review_scope", """
SELECT b.repo_id, count(c.id) AS commit_count, CASE WHEN count(c.id) = 1 THEN 'DIFF_REVIEW' WHEN count(c.id) > 1 THEN 'BRANCH_REVIEW' ELSE 'FULL_SCAN' END AS scope
FROM (SELECT DISTINCT repo_id || branch AS repo_id FROM commits) b
LEFT JOIN (SELECT repo_id || branch AS repo_id, id FROM commits WHERE created_at >= TIMESTAMP '1998-01-01') c ON b.repo_id = c.repo_id GROUP BY 1""")
def _(src):
    per = src.commits.withColumn("repo_id", F.concat("repo_id", "branch"))
    return S.review_scope(S.time_window(per, "1998-01-01"), per.select("repo_id").distinct())


@query("union_external_log", """
SELECT repo_id, message, author_name FROM commits UNION ALL
SELECT repo_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 'External' FROM (SELECT repo_id, unnest(string_split(message, chr(10))) AS line FROM messages) WHERE trim(line) <> ''""")
def _(src):
    logs = src.messages.select("repo_id", F.col("message").alias("body"))
    out = S.union_external_log(src.commits, logs, F.lit("2002-01-01").cast("timestamp"))
    return out.select("repo_id", "message", "author_name")


@query("run_history", "SELECT task_id, project, status, created_at FROM run_log WHERE project = 'P7' ORDER BY created_at DESC, ord DESC")
def _(src):
    return history.run_history(src.run_log, "P7").select("task_id", "project", "status", "created_at")


@query("recent_runs", "SELECT task_id, project, status, created_at FROM run_log ORDER BY created_at DESC, ord DESC LIMIT 10")
def _(src):
    return history.recent_runs(src.run_log).select("task_id", "project", "status", "created_at")


@query("project_by_code", "SELECT code, name, active FROM projects WHERE code = 'P3'")
def _(src):
    return history.project_by_code(src.projects, "P3")


@query("active_projects", "SELECT code, name, active FROM projects WHERE active")
def _(src):
    return history.active_projects(src.projects)


# ---- cleaning and classes

@query("sanitize_commit_message", f"SELECT ord, {sql_clean('message')} AS cleaned FROM commits")
def _(src):
    return C.cleaned(src.commits).select("ord", "cleaned")


@query("sanitize_long_message", f"SELECT ord, {sql_clean('message')} AS cleaned FROM messages")
def _(src):
    return C.cleaned(src.messages).select("ord", "cleaned")


FIRST = f"""(SELECT * REPLACE (cleaned AS message), message AS raw_message FROM (SELECT *, {sql_clean('message')} AS cleaned FROM commits)
  WHERE cleaned <> '' QUALIFY row_number() OVER (PARTITION BY repo_id, cleaned ORDER BY ord) = 1)"""


@query("dedupe_by_message", f"SELECT repo_id, id, message, raw_message FROM {FIRST}")
def _(src):
    return C.dedupe_by_message(src.commits).select("repo_id", "id", "message", "raw_message")


@query("rule_classify", f"SELECT id, message, category FROM {RULED}")
def _(src):
    return classed(src).select("id", "message", "category")


@query("rule_classify_cleaned", f"SELECT id, {sql_rule_category('message')} AS category FROM {FIRST}")
def _(src):
    return C.classify(C.dedupe_by_message(src.commits)).select("id", "category")


def rule_rows(src):
    """Rules table derived from the brand and type names of the parts."""
    return src.spark.read.parquet(f"{src.sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(
        F.min("o_orderkey").alias("k")
    ).select(
        F.lower("o_orderpriority").alias("code"), F.col("o_orderpriority").alias("label"), F.lit("").alias("prefixes"),
        F.concat_ws(",", "o_orderpriority", F.lit("zz")).alias("keywords"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


@query("rules_as_data", """
SELECT id, coalesce((SELECT min(lower(o_orderpriority)) FROM (SELECT DISTINCT o_orderpriority FROM orders) p WHERE contains(message, o_orderpriority)), 'other') AS category FROM commits""")
def _(src):
    return C.classify(src.commits, rules=C.rules_from_table(rule_rows(src))).select("id", "category")


FEEDBACK = "(SELECT repo_id, message, max_by(CASE WHEN ord % 2 = 0 THEN 'perf' ELSE 'style' END, ord) AS category FROM commits WHERE branch LIKE 'b1%' GROUP BY repo_id, message)"
REPLIES = "(SELECT repo_id, message, CASE WHEN max(ord) % 3 = 0 THEN '我认为是 Bug修复' WHEN max(ord) % 3 = 1 THEN 'CI配置' ELSE '?' END AS reply FROM commits WHERE branch LIKE 'b2%' GROUP BY repo_id, message)"


def feedback(src):
    rows = src.commits.where("branch LIKE 'b1%'").select(
        "repo_id", "message", F.when(F.col("ord") % 2 == 0, "perf").otherwise("style").alias("category"), F.col("created_at").alias("ts"), "ord"
    )
    return C.latest_feedback(rows.withColumn("ts", F.lit(0)))


def replies(src):
    k = F.max("ord") % 3
    return src.commits.where("branch LIKE 'b2%'").groupBy("repo_id", "message").agg(
        F.when(k == 0, "我认为是 Bug修复").when(k == 1, "CI配置").otherwise("?").alias("reply")
    )


@query("record_feedback", f"SELECT repo_id, message, category FROM {FEEDBACK}")
def _(src):
    return feedback(src)


REPLY_LABEL = "CASE WHEN contains(reply, 'Bug修复') THEN 'bugfix' WHEN contains(reply, 'CI配置') THEN 'ci' ELSE 'other' END"


@query("label_precedence", f"""
SELECT c.id, CASE WHEN trim(c.message) = '' THEN 'other' WHEN f.category IS NOT NULL THEN f.category WHEN c.category <> 'other' THEN c.category
  WHEN r.reply IS NOT NULL THEN {REPLY_LABEL} ELSE 'other' END AS category,
  CASE WHEN trim(c.message) = '' THEN 'rule' WHEN f.category IS NOT NULL THEN 'feedback' WHEN c.category <> 'other' THEN 'rule' WHEN r.reply IS NOT NULL THEN 'model' ELSE 'rule' END AS source
FROM {RULED} c LEFT JOIN {FEEDBACK} f ON f.repo_id = c.repo_id AND f.message = c.message LEFT JOIN {REPLIES} r ON r.repo_id = c.repo_id AND r.message = c.message""")
def _(src):
    return C.label(src.commits, feedback(src), replies(src)).select("id", "category", "source")


@query("normalise_model_label", f"SELECT repo_id, message, {REPLY_LABEL} AS category FROM {REPLIES}")
def _(src):
    from gitstrata.functions.text import label_in_reply

    return replies(src).select("repo_id", "message", label_in_reply(F.col("reply")).alias("category"))


GATED = "SELECT rid AS id, l_orderkey AS batch, CAST(rid - l_orderkey * 1000 - 1 AS INT) AS position, l_partkey AS ord FROM li"


@query("format_gate", f"SELECT id, batch, position FROM ({GATED}) WHERE NOT (position < 4 AND ord % 5 = 0)")
def _(src):
    rows = src.sql(GATED)
    verdict = F.when(F.col("ord") % 5 == 0, "不通过").otherwise("通过")
    lines = F.array_sort(F.collect_list(F.struct("position", verdict.alias("v"))))
    batches = rows.where("position < 4").groupBy("batch").agg(
        F.concat(F.lit("verdicts\n"), F.array_join(F.transform(lines, lambda x: x["v"]), "\n")).alias("reply")
    )
    return C.format_gate(rows, batches).select("id", "batch", "position")


@query("category_counts", f"SELECT repo_id, category, count(*) AS n FROM {RULED} GROUP BY ALL")
def _(src):
    return C.category_counts(classed(src))


POS = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(dims.DISPLAY_ORDER, 1)) + " END"


@query("categories_in_order", f"SELECT repo_id, category, count(*) AS n, {POS} AS position FROM {RULED} GROUP BY ALL")
def _(src):
    return C.categories_in_order(classed(src))


@query("commit_totals", "SELECT repo_id, count(*) AS commits, count(DISTINCT author_name) AS authors FROM commits GROUP BY repo_id")
def _(src):
    return C.totals(src.commits)


for _dim, _expr in {
    "author": AUTHOR, "time": "coalesce(strftime(created_at, '%Y-%m-%d'), 'unknown')", "branch": "'default'", "project": "'all'",
}.items():
    @query(f"group_by_{_dim}", f"SELECT repo_id, {_expr} AS group_key, count(*) AS n FROM commits GROUP BY ALL")
    def _(src, _dim=_dim):
        return C.group_by_dimension(src.commits, _dim.upper())


# ---- contributors

COUNTS = f"(SELECT repo_id, {AUTHOR} AS author, count(*) AS n, min(ord) AS first_ord FROM commits GROUP BY ALL)"
SHARED = f"""(SELECT *, floor(n / sum(n) OVER (PARTITION BY repo_id) * 100.0 * 100 + 0.5) / 100 AS share,
  n / sum(n) OVER (PARTITION BY repo_id) * 100.0 < 100.0 / count(*) OVER (PARTITION BY repo_id) * 0.25 AS low_activity FROM {COUNTS})"""


@query("commits_per_author_category", f"SELECT repo_id, {AUTHOR} AS author, category, count(*) AS n FROM {RULED} GROUP BY ALL")
def _(src):
    return D.by_category(classed(src))


@query("author_category_pivot", f"""SELECT repo_id, {AUTHOR} AS author, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in dims.DISPLAY_ORDER)} FROM {RULED} GROUP BY ALL""")
def _(src):
    return D.category_pivot(classed(src), dims.DISPLAY_ORDER)


@query("author_share", f"SELECT repo_id, author, n, share FROM {SHARED}")
def _(src):
    return D.shares(D.by_author(src.commits)).select("repo_id", "author", "n", "share")


@query("low_activity_flag", f"SELECT repo_id, author, low_activity FROM {SHARED}")
def _(src):
    return D.shares(D.by_author(src.commits)).select("repo_id", "author", "low_activity")


@query("first_email", f"SELECT repo_id, {AUTHOR} AS author, min_by(author_email, ord) AS email FROM commits WHERE author_email IS NOT NULL GROUP BY ALL")
def _(src):
    return D.emails(src.commits)


@query("category_distribution", f"""
SELECT repo_id, author, list_aggregate(list_sort(list(category || '=' || n)), 'string_agg', ';') AS distribution FROM
 (SELECT repo_id, {AUTHOR} AS author, category, count(*) AS n FROM {RULED} GROUP BY ALL) GROUP BY ALL""")
def _(src):
    out = D.category_distribution(classed(src))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("repo_id", "author", flat.alias("distribution"))


@query("monthly_frequency", f"SELECT repo_id, {AUTHOR} AS author, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM commits GROUP BY ALL")
def _(src):
    return D.monthly(src.commits)


@query("low_activity_details", f"""
SELECT c.repo_id, {AUTHOR} AS author, left(id, 8) AS short_id, message, category, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, ord
FROM {RULED} c WHERE EXISTS (SELECT 1 FROM {SHARED} s WHERE s.low_activity AND s.repo_id = c.repo_id AND s.author = coalesce(c.author_name, 'unknown'))""")
def _(src):
    return D.low_activity_details(classed(src))


@query("contributor_ranking", f"""
SELECT repo_id, author, n, first_ord, share, low_activity, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, first_ord) AS position FROM {SHARED}""")
def _(src):
    return D.contributor_ranking(src.commits)


@query("main_areas", f"""
SELECT repo_id, author, string_agg(category, '、' ORDER BY rn) AS areas FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, author ORDER BY n DESC, {POS}) AS rn
 FROM (SELECT repo_id, {AUTHOR} AS author, category, count(*) AS n FROM {RULED} GROUP BY ALL)) WHERE rn <= 2 GROUP BY ALL""")
def _(src):
    return D.main_areas(classed(src))


@query("message_preview", "SELECT ord, coalesce(replace(CASE WHEN length(message) > 60 THEN left(message, 60) || '...' ELSE message END, '|', '\\|'), '-') AS preview FROM messages")
def _(src):
    return D.with_preview(src.messages).select("ord", "preview")
