"""Queries over diffs, blame and developers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.operators import churn as X
from gitstrata.operators import commits as C
from gitstrata.operators import hunks as H
from gitstrata.operators import origins as E
from gitstrata.plans.commit_queries import RULED, parents
from gitstrata.plans.registry import query

# Every fixture diff has one hunk, and a second one where the supplier key is a multiple of 3.
HUNKS = r"""(SELECT d.repo_id, d.commit_id, d.rid, d.path, d.change_type, CAST(h.k AS INT) AS hunk_no,
  CASE WHEN h.k = 0 THEN l.l_linenumber * 5 ELSE l.l_linenumber * 5 + 20 END AS old_start, CASE WHEN h.k = 0 THEN CAST(l.l_quantity AS INT) % 5 ELSE 1 END AS old_count,
  CASE WHEN h.k = 0 THEN l.l_linenumber * 5 ELSE l.l_linenumber * 5 + 21 END AS new_start, CASE WHEN h.k = 0 THEN 1 ELSE 2 END AS new_count
 FROM diffs d JOIN li l ON l.rid = d.rid JOIN (SELECT unnest([0, 1]) AS k) h ON h.k = 0 OR l.l_suppkey % 3 = 0)"""
NUM = ["repo_id", "commit_id", "rid", "path", "hunk_no", "old_start", "old_count", "new_start", "new_count"]


@query("hunk_extract", f"SELECT {', '.join(NUM)} FROM {HUNKS}")
def _(src):
    return H.hunks(src.diffs).select(*NUM)


@query("hunk_body", f"""
SELECT h.rid, h.hunk_no, CASE WHEN hunk_no = 0 THEN 'ctx' ELSE '' END AS context_before,
  CASE WHEN hunk_no = 0 THEN '-old ' || h.rid || chr(10) || '+new ' || h.rid ELSE '+more ' || l.l_partkey END AS change_text,
  CASE WHEN hunk_no = 0 AND l.l_suppkey % 3 = 0 THEN 'tail' ELSE '' END AS context_after FROM {HUNKS} h JOIN li l ON l.rid = h.rid""")
def _(src):
    return H.bodies(H.hunks(src.diffs)).select("rid", "hunk_no", "context_before", "change_text", "context_after")


@query("old_line_ranges", f"SELECT rid, hunk_no, old_start AS first, old_start + old_count - 1 AS last FROM {HUNKS} WHERE old_count > 0")
def _(src):
    return H.old_ranges(H.hunks(src.diffs)).select("rid", "hunk_no", "first", "last")


@query("old_lines", f"SELECT rid, hunk_no, unnest(generate_series(old_start, old_start + old_count - 1)) AS line_no FROM {HUNKS} WHERE old_count > 0")
def _(src):
    return H.old_lines(H.hunks(src.diffs)).select("rid", "hunk_no", "line_no")


KIND = "CASE WHEN old_count = 0 AND new_count > 0 THEN 'ADD' WHEN old_count > 0 AND new_count = 0 THEN 'DELETE' ELSE 'MODIFY' END"


@query("change_kind", f"SELECT rid, hunk_no, {KIND} AS kind FROM {HUNKS}")
def _(src):
    return H.with_kind(H.hunks(src.diffs)).select("rid", "hunk_no", "kind")


@query("diff_size_guard", "SELECT rid, length(unified_diff) AS n FROM diffs WHERE length(unified_diff) <= 180")
def _(src):
    return H.within_size(src.diffs, 180).select("rid", F.length("unified_diff").alias("n"))


@query("path_from_diff_header", "SELECT rid, path FROM diffs")
def _(src):
    return src.diffs.select("rid", H.path_in_header(F.col("unified_diff")).alias("path"))


# ---- bug origin

FIX = f"(SELECT * FROM {RULED} WHERE category = 'bugfix')"
BLAMED = f"""(SELECT DISTINCT h.repo_id, h.commit_id AS fix_id, h.path, b.line_no, b.author_name AS author, b.commit_id
 FROM {HUNKS} h JOIN {FIX} f ON f.repo_id = h.repo_id AND f.id = h.commit_id AND f.parent1 IS NOT NULL AND f.parent2 IS NULL
 JOIN blame_at b ON b.repo_id = h.repo_id AND b.commit_id_at = f.parent1 AND b.path = h.path AND b.author_name IS NOT NULL
  AND h.old_count > 0 AND b.line_no BETWEEN h.old_start AND h.old_start + h.old_count - 1 WHERE h.change_type <> 'DELETE')"""
PER_FILE = f"(SELECT repo_id, fix_id, path, author, commit_id, count(*) AS lines FROM {BLAMED} GROUP BY ALL)"
LINKS = f"(SELECT repo_id, fix_id, commit_id, author, list_sort(list(DISTINCT path)) AS paths, CAST(sum(lines) AS BIGINT) AS lines FROM {PER_FILE} GROUP BY ALL)"
SHARED = f"""(SELECT *, 1.0 / count(*) OVER w AS share, lines / sum(lines) OVER w AS line_share FROM {LINKS} WINDOW w AS (PARTITION BY repo_id, fix_id, commit_id))"""
BUGS = f"(SELECT s.*, coalesce(f.author_name, 'unknown') AS fixed_by FROM {SHARED} s JOIN {FIX} f ON f.repo_id = s.repo_id AND f.id = s.fix_id)"
# Statuses: every introducing commit whose number is a multiple of 5 is a false positive.
FALSE = "CAST(commit_id AS INT) % 5 = 0"
METRICS = f"""(SELECT coalesce(c.repo_id, b.repo_id, x.repo_id) AS repo_id, coalesce(c.author, b.author, x.author) AS author, coalesce(total_commits, 0) AS total_commits,
  coalesce(bugs_introduced, 0) AS bugs_introduced, coalesce(links, 0) AS links, coalesce(confirmed, 0) AS confirmed, coalesce(false_positive, 0) AS false_positive, coalesce(fixes_made, 0) AS fixes_made,
  CASE WHEN coalesce(total_commits, 0) > 0 THEN coalesce(bugs_introduced, 0) / total_commits ELSE 0 END AS bug_rate
 FROM (SELECT repo_id, coalesce(author_name, 'unknown') AS author, count(*) AS total_commits FROM commits GROUP BY ALL) c
 FULL JOIN (SELECT repo_id, author, CAST(sum(share) AS DOUBLE) AS bugs_introduced, count(*) AS links, count(*) FILTER (NOT ({FALSE})) AS confirmed, count(*) FILTER ({FALSE}) AS false_positive FROM {BUGS} GROUP BY ALL) b
  ON b.repo_id = c.repo_id AND b.author = c.author
 FULL JOIN (SELECT repo_id, fixed_by AS author, count(DISTINCT fix_id) AS fixes_made FROM {BUGS} GROUP BY ALL) x ON x.repo_id = coalesce(c.repo_id, b.repo_id) AND x.author = coalesce(c.author, b.author))"""


def fixing(src):
    return E.fix_commits(C.classify(parents(src.commits)))


def blamed(src):
    return E.blamed_lines(E.fixed_ranges(fixing(src), src.diffs), src.blame_at)


def links(src):
    return E.bug_links(fixing(src), src.diffs, src.blame_at)


def statuses(df):
    return df.select("repo_id", "fix_id", "commit_id", "author", F.when(F.col("commit_id").cast("int") % 5 == 0, "FALSE_POSITIVE").alias("status"))


def metrics(src):
    found = cut(links(src))
    return E.developer_metrics(src.commits, found, statuses(found))


@query("fix_commits", f"SELECT id, message FROM {FIX}")
def _(src):
    return fixing(src).select("id", "message")


@query("single_parent_commits", f"SELECT id FROM {FIX} WHERE parent1 IS NOT NULL AND parent2 IS NULL")
def _(src):
    return E.single_parent(fixing(src)).select("id")


@query("blame_lookup", f"SELECT repo_id, fix_id, path, line_no, author, commit_id FROM {BLAMED}")
def _(src):
    return blamed(src).select("repo_id", "fix_id", "path", "line_no", "author", "commit_id")


@query("blame_per_file", f"SELECT * FROM {PER_FILE}")
def _(src):
    return E.per_file(blamed(src))


@query("blame_per_file_first_commit", f"SELECT repo_id, fix_id, path, author, min_by(commit_id, line_no) AS commit_id, count(*) AS lines FROM {BLAMED} GROUP BY ALL")
def _(src):
    return E.per_file(blamed(src), credit="first_commit")


@query("blame_across_files", f"SELECT repo_id, fix_id, commit_id, author, array_to_string(paths, ';') AS paths, lines FROM {LINKS}")
def _(src):
    return E.across_files(E.per_file(blamed(src))).withColumn("paths", F.array_join("paths", ";"))


@query("bug_share", f"SELECT repo_id, fix_id, commit_id, author, CAST(share AS DOUBLE) AS share, CAST(line_share AS DOUBLE) AS line_share FROM {SHARED}")
def _(src):
    return E.with_share(E.across_files(E.per_file(blamed(src)))).select("repo_id", "fix_id", "commit_id", "author", "share", "line_share")


@query("developer_commit_totals", "SELECT repo_id, coalesce(author_name, 'unknown') AS author, count(*) AS total_commits FROM commits GROUP BY ALL")
def _(src):
    return E.commit_totals(src.commits).drop("email")


@query("bugs_introduced", f"SELECT repo_id, author, CAST(sum(share) AS DOUBLE) AS bugs_introduced FROM {BUGS} GROUP BY ALL")
def _(src):
    return E.introduced(links(src)).select("repo_id", "author", "bugs_introduced")


@query("attribution_counts", f"SELECT repo_id, author, count(*) FILTER (NOT ({FALSE})) AS confirmed, count(*) FILTER ({FALSE}) AS false_positive FROM {BUGS} GROUP BY ALL")
def _(src):
    found = links(src)
    return E.introduced(found, statuses(found)).select("repo_id", "author", "confirmed", "false_positive")


@query("fix_dedupe", f"""
SELECT repo_id, fix_id, fixed_by, array_to_string(list_distinct_ordered, ';') AS introducers, cs AS commits FROM
 (SELECT repo_id, fix_id, fixed_by, list(author ORDER BY c, author) AS list_distinct_ordered FROM (SELECT repo_id, fix_id, fixed_by, author, min(commit_id) AS c FROM {BUGS} GROUP BY ALL) GROUP BY ALL)
 JOIN (SELECT repo_id, fix_id, string_agg(DISTINCT commit_id, ';' ORDER BY commit_id) AS cs FROM {BUGS} GROUP BY ALL) USING (repo_id, fix_id)""")
def _(src):
    f = E.fixes(links(src))
    return f.select("repo_id", "fix_id", "fixed_by", F.array_join("introducers", ";").alias("introducers"), F.array_join("commits", ";").alias("commits"))


@query("fix_introducers", f"""
SELECT DISTINCT b.repo_id, b.fix_id, b.commit_id, b.author, b.fixed_by, c.message AS introduced_message FROM {BUGS} b LEFT JOIN commits c ON c.repo_id = b.repo_id AND c.id = b.commit_id""")
def _(src):
    return E.fix_introducers(links(src), src.commits)


@query("fix_paths", f"SELECT repo_id, fix_id, path, commit_id, CAST(sum(lines) AS BIGINT) AS lines FROM {PER_FILE} GROUP BY ALL")
def _(src):
    return E.fix_paths(E.per_file(blamed(src)))


@query("fixes_made", f"SELECT repo_id, fixed_by AS author, count(DISTINCT fix_id) AS fixes_made FROM {BUGS} GROUP BY ALL")
def _(src):
    return E.fixes_made(links(src))


METRIC_COLS = ["repo_id", "author", "total_commits", "bugs_introduced", "links", "confirmed", "false_positive", "fixes_made"]


@query("developer_metrics", f"SELECT {', '.join(METRIC_COLS)} FROM {METRICS}")
def _(src):
    return metrics(src).select(*METRIC_COLS)


@query("bug_rate", f"SELECT repo_id, author, bug_rate FROM {METRICS}")
def _(src):
    return metrics(src).select("repo_id", "author", "bug_rate")


@query("metrics_without_fixes", "SELECT repo_id, coalesce(author_name, 'unknown') AS author, count(*) AS total_commits, CAST(0 AS DOUBLE) AS bugs_introduced, CAST(0 AS DOUBLE) AS bug_rate FROM commits GROUP BY ALL")
def _(src):
    none = links(src).where(F.lit(False))
    return E.developer_metrics(src.commits, none).select("repo_id", "author", "total_commits", "bugs_introduced", "bug_rate")


@query("introducer_ranking", f"SELECT repo_id, author, bugs_introduced, row_number() OVER (PARTITION BY repo_id ORDER BY round(bugs_introduced, 6) DESC, author) AS position FROM {METRICS} WHERE links > 0")
def _(src):
    return E.introducer_ranking(metrics(src)).select("repo_id", "author", "bugs_introduced", "position")


@query("fixer_ranking", f"""
SELECT repo_id, fixed_by AS author, count(DISTINCT fix_id) AS fixes_made, row_number() OVER (PARTITION BY repo_id ORDER BY count(DISTINCT fix_id) DESC, fixed_by) AS position FROM {BUGS} GROUP BY repo_id, fixed_by""")
def _(src):
    return E.fixer_ranking(links(src)).select("repo_id", "author", "fixes_made", "position")


@query("fix_targets", f"""
SELECT repo_id, fixed_by AS author, target, count(*) AS n FROM (SELECT repo_id, fix_id, fixed_by, string_agg(author, '; ' ORDER BY c, author) AS target FROM
 (SELECT repo_id, fix_id, fixed_by, author, min(commit_id) AS c FROM {BUGS} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""")
def _(src):
    return E.fix_targets(links(src))


@query("unremediated_findings", """
SELECT ord, file, start_line || '-' || end_line AS lines, severity, coalesce(trim(replace(trigger_text, chr(10), ' ')), '-') AS problem, coalesce(nullif(owner, ''), 'unassigned') AS owner, status
FROM findings WHERE severity IN ('P0', 'P1')""")
def _(src):
    return E.unremediated(src.findings).select("ord", "file", "lines", "severity", "problem", "owner", "status")


OWNERS = """(SELECT repo_id, trim(regexp_replace(o, '\\(\\d+%\\)', '')) AS author, count(*) FILTER (status = 'CONFIRMED') AS open_confirmed, count(*) AS open_total
 FROM (SELECT repo_id, status, unnest(string_split(owner, ', ')) AS o FROM findings WHERE coalesce(owner, '') <> '') GROUP BY ALL)"""


@query("owner_explode", f"SELECT repo_id, author, open_confirmed, open_total FROM {OWNERS}")
def _(src):
    return E.open_by_owner(src.findings)


@query("developer_portrait", f"""
SELECT m.repo_id, m.author, m.bugs_introduced, m.confirmed, coalesce(o.open_confirmed, 0) AS open_confirmed, coalesce(o.open_total, 0) AS open_total,
 CASE WHEN coalesce(o.open_total, 0) >= 5 AND o.open_confirmed >= 3 THEN 'many open findings' WHEN coalesce(o.open_total, 0) > 0 AND m.confirmed > 0 THEN 'confirmed bugs and open findings'
  WHEN coalesce(o.open_total, 0) > 0 THEN 'open findings' ELSE '-' END AS signal FROM {METRICS} m LEFT JOIN {OWNERS} o ON o.repo_id = m.repo_id AND o.author = m.author""")
def _(src):
    return E.portrait(metrics(src), src.findings)


HIGH = "SELECT repo_id, count(*) FILTER (severity IN ('P0', 'P1')) AS h, count(DISTINCT file) AS files FROM findings GROUP BY 1"


@query("collaboration_signals", f"""
WITH m AS (SELECT * FROM {METRICS}), b AS (SELECT * FROM {BUGS})
SELECT repo_id, 'linked_commit_rate' AS signal, author, CAST(CASE WHEN total_commits > 0 THEN links / total_commits * 100 ELSE 0 END AS DOUBLE) AS value FROM m WHERE links > 0
UNION ALL SELECT repo_id, 'fixes_made', author, fixes_made FROM m WHERE fixes_made > 0
UNION ALL SELECT repo_id, 'fix_commits', NULL, count(*) FROM {FIX} GROUP BY 1
UNION ALL SELECT repo_id, 'bug_links', NULL, count(*) FROM b GROUP BY 1
UNION ALL SELECT repo_id, 'confirmed', NULL, sum(confirmed) FROM m GROUP BY 1
UNION ALL SELECT repo_id, 'false_positive', NULL, sum(false_positive) FROM m GROUP BY 1
UNION ALL SELECT repo_id, 'open_high', NULL, h FROM ({HIGH}) UNION ALL SELECT repo_id, 'open_files', NULL, files FROM ({HIGH})""")
def _(src):
    found = cut(links(src))
    n = fixing(src).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return E.collaboration_signals(E.developer_metrics(src.commits, found, statuses(found)), found, n, src.findings)


# ---- churn

CHANGES = f"""(SELECT h.repo_id, h.path, h.commit_id, h.rid, h.hunk_no, h.old_start, h.old_count, h.new_start, h.new_count, {KIND} AS kind, coalesce(c.author_name, 'unknown') AS author_name, c.created_at
 FROM {HUNKS} h JOIN commits c ON c.repo_id = h.repo_id AND c.id = h.commit_id WHERE (c.parent1 IS NULL) <> (c.parent2 IS NULL))"""
EVENTS = f"""(SELECT *, 0 AS step FROM (SELECT *, unnest(generate_series(old_start, old_start + greatest(old_count, 1) - 1)) AS line_no FROM {CHANGES} WHERE kind <> 'ADD')
 UNION ALL SELECT *, 1 FROM (SELECT *, unnest(generate_series(old_start, old_start + old_count - 1)) AS line_no FROM {CHANGES} WHERE old_count > 0)
 UNION ALL SELECT *, 2 FROM (SELECT *, unnest(generate_series(new_start, new_start + new_count - 1)) AS line_no FROM {CHANGES} WHERE new_count > 0))"""


def changes(src):
    diffs = src.diffs.withColumnRenamed("rid", "seq")
    return X.change_hunks(parents(src.commits), diffs)


@query("line_ownership", f"""
SELECT repo_id, path, line_no, author_name AS owner, commit_id FROM (SELECT * FROM {EVENTS} WHERE step > 0
 QUALIFY row_number() OVER (PARTITION BY repo_id, path, line_no ORDER BY created_at DESC, commit_id DESC, rid DESC, hunk_no DESC, step DESC) = 1) WHERE step = 2""")
def _(src):
    return X.line_owners(changes(src))


PAIRS = f"""
SELECT repo_id, path, commit_id, rid AS seq, hunk_no, min(line_no) AS line_no, arg_min(pa, line_no) AS prev_author, arg_min(pc, line_no) AS prev_commit, any_value(author_name) AS cur_author FROM
 (SELECT *, last_value(CASE WHEN step > 0 THEN step END IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN step > 0 THEN author_name END IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN step > 0 THEN commit_id END IGNORE NULLS) OVER w AS pc
  FROM {EVENTS} WINDOW w AS (PARTITION BY repo_id, path, line_no ORDER BY created_at, commit_id, rid, hunk_no, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE step = 0 AND ps = 2 AND pa <> author_name GROUP BY ALL"""


@query("repeated_change_pairs", PAIRS)
def _(src):
    out = X.repeated_changes(changes(src))
    return out.select("repo_id", "path", "commit_id", "seq", "hunk_no", "line_no", F.col("prev.author_name").alias("prev_author"),
                      F.col("prev.commit_id").alias("prev_commit"), F.col("cur.author_name").alias("cur_author"))


@query("change_snippet", f"""
SELECT h.rid, h.hunk_no, CASE WHEN hunk_no = 0 THEN 'ctx' || chr(10) || '-old ' || h.rid || chr(10) || '+new ' || h.rid || CASE WHEN l.l_suppkey % 3 = 0 THEN chr(10) || 'tail' ELSE '' END
 ELSE '+more ' || l.l_partkey END AS snippet FROM {HUNKS} h JOIN li l ON l.rid = h.rid""")
def _(src):
    return X.snippet(H.hunks(src.diffs)).select("rid", "hunk_no", "snippet")


@query("intent_label_parse", """
SELECT ord, CASE ord % 4 WHEN 0 THEN 'FIX' WHEN 1 THEN 'ENHANCE' ELSE 'UNCERTAIN' END AS intent, CASE ord % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 CASE WHEN ord % 4 < 2 THEN author_name WHEN ord % 4 = 2 THEN '' END AS reason FROM messages""")
def _(src):
    k = F.col("ord") % 4
    reply = (
        F.when(k == 0, F.concat(F.lit("text\n## fix bug | 高 | "), "author_name"))
        .when(k == 1, F.concat(F.lit("Feature|medium| "), "author_name"))
        .when(k == 2, "dunno|maybe").otherwise("no idea")
    )
    return X.parse_intent(src.messages.select("ord", reply.alias("reply"))).select("ord", "intent", "confidence", "reason")
