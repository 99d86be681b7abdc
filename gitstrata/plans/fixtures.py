"""Views that give the given tables the shape of repository data.

One SQL text serves Spark and DuckDB.  ``SERIES(a, b)`` is the only thing that is
spelled differently per engine.  Every view reads whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["li"] = """
SELECT *, l_orderkey * 1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rid
FROM lineitem
"""

VIEWS["files"] = """
SELECT n, CONCAT('repo', CAST(n % 4 AS STRING)) AS repo_id, module, layer, CONCAT('C', CAST(n AS STRING), suffix) AS cls,
  CONCAT('com.acme.', module, '.', layer) AS pkg,
  CONCAT('src/main/java/com/acme/', module, '/', layer, '/C', CAST(n AS STRING), suffix, '.java') AS path
FROM (SELECT n,
  SPLIT_PART('billing|user|order|stock|report|auth', '|', CAST((n - n % 4) / 4 AS INT) % 6 + 1) AS module,
  SPLIT_PART('controller|service|dao|model|util', '|', CAST((n - n % 24) / 24 AS INT) % 5 + 1) AS layer,
  SPLIT_PART('Controller|Service|Dao|Entity|Util', '|', CAST((n - n % 24) / 24 AS INT) % 5 + 1) AS suffix
  FROM (SELECT CAST(p_partkey AS INT) AS n FROM part) p) t
"""

VIEWS["commits"] = """
SELECT CONCAT('repo', CAST(o_orderkey % 4 AS STRING)) AS repo_id,
  LPAD(CAST(o_orderkey AS STRING), 8, '0') AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'dev0'
       WHEN o_custkey % 10 = 3 THEN CONCAT('solo', CAST(o_custkey AS STRING))
       ELSE CONCAT('dev', CAST(o_custkey - o_custkey % 50 AS STRING)) END AS author_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CONCAT('u', CAST(o_custkey AS STRING), '@x.org') END AS author_email,
  CONCAT(SPLIT_PART('feat: |fix: |update: |refactor: |docs: |perf: |test: |build: |ci: |style: |deps: |fix(core): |[Feature] |add |新增|', '|',
    CAST(o_orderkey % 16 AS INT) + 1), o_orderpriority, ' item ', CAST(o_custkey AS STRING)) AS message,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey < 4 THEN NULL ELSE LPAD(CAST(o_orderkey - 4 AS STRING), 8, '0') END AS parent1,
  CASE WHEN o_orderkey % 25 = 0 AND o_orderkey >= 8 THEN LPAD(CAST(o_orderkey - 8 AS STRING), 8, '0') END AS parent2,
  CONCAT('b', CAST(o_custkey AS STRING)) AS branch,
  o_orderkey AS ord
FROM orders
"""

VIEWS["refs"] = """
SELECT CONCAT('repo', CAST(MAX(o_orderkey) % 4 AS STRING)) AS repo_id,
  CONCAT(CASE WHEN o_custkey % 10 = 7 THEN 'refs/tags/b' ELSE 'refs/remotes/origin/b' END, CAST(o_custkey AS STRING)) AS name,
  LPAD(CAST(MAX(o_orderkey) AS STRING), 8, '0') AS commit_id
FROM orders GROUP BY o_custkey
"""

VIEWS["tracker"] = """
SELECT repo_id, branch, MIN(id) AS last_hash, MIN(created_at) AS updated_at FROM commits GROUP BY repo_id, branch
"""

VIEWS["commit_feed"] = """
SELECT event_id AS ord, CONCAT('repo', CAST(user_id % 3 AS STRING)) AS repo_id, CONCAT('dev', CAST(user_id AS STRING)) AS author_name, ts AS created_at,
  CONCAT(CASE event_type WHEN 'error' THEN 'fix: ' WHEN 'signup' THEN 'feat: ' WHEN 'purchase' THEN 'update: ' ELSE '' END,
    event_type, ' ', props) AS message
FROM events
"""

VIEWS["messages"] = """
SELECT doc_id AS ord, CONCAT('repo', CAST(doc_id % 4 AS STRING)) AS repo_id, source AS author_name, text AS message FROM documents
"""

VIEWS["diffs"] = """
SELECT CONCAT('repo', CAST(l.l_orderkey % 4 AS STRING)) AS repo_id, LPAD(CAST(l.l_orderkey AS STRING), 8, '0') AS commit_id,
  l.rid, f.path, CASE l_returnflag WHEN 'A' THEN 'ADD' WHEN 'R' THEN 'DELETE' ELSE 'MODIFY' END AS change_type,
  CONCAT('diff --git a/', f.path, ' b/', f.path, CHR(10), '@@ -', CAST(l_linenumber * 5 AS STRING), ',', CAST(CAST(l_quantity AS INT) % 5 AS STRING),
    ' +', CAST(l_linenumber * 5 AS STRING), ' @@', CHR(10), ' ctx', CHR(10), '-old ', CAST(l.rid AS STRING), CHR(10), '+new ', CAST(l.rid AS STRING),
    CASE WHEN l_suppkey % 3 = 0 THEN CONCAT(CHR(10), ' tail', CHR(10), '@@ -', CAST(l_linenumber * 5 + 20 AS STRING), ' +', CAST(l_linenumber * 5 + 21 AS STRING), ',2 @@',
      CHR(10), '+more ', CAST(l_partkey AS STRING)) ELSE '' END) AS unified_diff
FROM li l JOIN files f ON l.l_partkey = f.n
"""

VIEWS["blame_at"] = """
SELECT DISTINCT repo_id, parent AS commit_id_at, path, line_no,
  CASE WHEN line_no % 11 = 0 THEN NULL ELSE CONCAT('dev', CAST((n * 31 + line_no - line_no % 3) % 37 AS STRING)) END AS author_name,
  LPAD(CAST((n * 13 + line_no - line_no % 3) % 1000 AS STRING), 8, '0') AS commit_id
FROM (SELECT CONCAT('repo', CAST(l_orderkey % 4 AS STRING)) AS repo_id, LPAD(CAST(l_orderkey - 4 AS STRING), 8, '0') AS parent,
  f.path, f.n, SERIES(l_linenumber * 5, l_linenumber * 5 + 2) AS line_no
  FROM lineitem l JOIN files f ON l.l_partkey = f.n WHERE l_orderkey >= 4) t
"""

VIEWS["blame_lines"] = """
SELECT repo_id, path, line_no,
  CASE WHEN line_no % 17 = 0 THEN NULL ELSE CONCAT('dev', CAST((n * 31 + line_no - line_no % 3) % 37 AS STRING)) END AS author_name,
  LPAD(CAST((n * 13 + line_no - line_no % 3) % 1000 AS STRING), 8, '0') AS commit_id
FROM (SELECT repo_id, path, n, SERIES(1, 50) AS line_no FROM files) t
"""

VIEWS["findings"] = """
SELECT l.rid AS ord, f.repo_id, f.path AS file, f.module AS module_name,
  CAST(1 + (l.l_orderkey * 7 + l.l_linenumber * 13) % 20000 AS INT) AS start_line,
  CAST(1 + (l.l_orderkey * 7 + l.l_linenumber * 13) % 20000 + CAST(l_quantity AS INT) % 9 AS INT) AS end_line,
  SPLIT_PART('SECURITY|NPE|TRANSACTION|CONCURRENCY|RESOURCE_LEAK|ERROR_HANDLING|SECRET_EXPOSURE|CODE_STYLE|PERFORMANCE|DEPENDENCY|ARCHITECTURE|COMPILE_ERROR|LOGIC_ERROR|HARDCODED|DEAD_CODE|OTHER',
    '|', CAST(l_suppkey % 16 AS INT) + 1) AS category,
  SPLIT_PART('P0|P1|P1|P1|P1|P1|P0|P3|P2|P2|P1|P1|P1|P3|P3|P4', '|', CAST(l_suppkey % 16 AS INT) + 1) AS severity,
  5e-1 + ROUND(l_discount * 100) / 2e1 AS confidence,
  CASE WHEN l_linestatus = 'F' THEN 'UNREVIEWED' WHEN l_discount < 0.045 THEN 'FALSE_POSITIVE' ELSE 'CONFIRMED' END AS status,
  CASE WHEN l_suppkey % 7 = 0 THEN 'try { run(); }' WHEN l_suppkey % 11 = 0 THEN NULL
       WHEN l_suppkey % 13 = 3 THEN CONCAT('pass', 'word=', 'p', CAST(l_partkey AS STRING)) ELSE CONCAT('x.call(', CAST(l_partkey AS STRING), ')') END AS evidence,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN ' ' ELSE CONCAT('case ', CAST(l_partkey % 50 AS STRING)) END AS trigger_text,
  CASE WHEN l_suppkey % 6 = 0 THEN 'wrap the call' END AS suggested_fix,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CONCAT('dev', CAST(l_suppkey % 37 AS STRING)) END AS candidate_handler,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL WHEN l_suppkey % 8 = 1 THEN CONCAT('dev', CAST(l_suppkey % 37 AS STRING), '(60%), dev', CAST(l_partkey % 41 AS STRING), '(40%)')
       ELSE CONCAT('dev', CAST(l_suppkey % 37 AS STRING)) END AS owner,
  CONCAT(f.cls, '.m', CAST(f.n - f.n % 8 AS STRING)) AS symbol
FROM li l JOIN files f ON l.l_partkey = f.n
"""

VIEWS["findings_small"] = """
SELECT ord, repo_id, file, module_name, CAST(1 + start_line % 45 AS INT) AS start_line, CAST(1 + start_line % 45 + (end_line - start_line) AS INT) AS end_line,
  category, severity, confidence, status, evidence, trigger_text, suggested_fix, candidate_handler, owner, symbol
FROM findings
"""

VIEWS["reviews"] = """
SELECT rid AS ord, CASE WHEN rid % 3 = 1 THEN 9e-1 WHEN rid % 3 = 2 THEN 4e-1 ELSE 12e-1 END AS confidence,
  CASE WHEN rid % 4 = 0 THEN 'npe' WHEN rid % 4 = 1 THEN 'OTHER' WHEN rid % 4 = 2 THEN '性能问题' END AS category,
  CASE WHEN rid % 5 = 0 THEN 'this might be fine' ELSE 'clear' END AS reason,
  CASE WHEN rid % 2 = 0 THEN 'on empty input' END AS trigger_text, 'add a check' AS suggested_fix
FROM li WHERE l_returnflag <> 'N'
"""

VIEWS["symbols"] = """
SELECT n, repo_id, CONCAT(path, '::', cls, '.m', CAST(n - n % 8 AS STRING)) AS qualified_name, CONCAT('m', CAST(n - n % 8 AS STRING)) AS name,
  CASE WHEN n % 10 = 9 THEN 'Class' ELSE 'Function' END AS kind, path AS file, module,
  CASE WHEN n % 7 = 0 THEN 'Transactional' END AS annotation, n AS ord
FROM files
"""

VIEWS["call_edges"] = """
SELECT DISTINCT s.repo_id, s.qualified_name AS source, t.qualified_name AS target
FROM (SELECT a.l_partkey - a.l_partkey % 4 + b.l_partkey % 4 AS src, b.l_partkey AS tgt
      FROM li a JOIN li b ON b.rid = a.rid + 1) e
JOIN symbols s ON s.n = e.src JOIN symbols t ON t.n = e.tgt
WHERE e.src <> e.tgt
"""

VIEWS["flows"] = """
SELECT CONCAT('repo', CAST(o_orderkey % 4 AS STRING)) AS repo_id, o_orderkey AS id, CONCAT('flow', CAST(o_orderkey AS STRING)) AS name,
  o_totalprice AS criticality FROM orders
"""

VIEWS["flow_files"] = """
SELECT DISTINCT f.repo_id, l.l_orderkey AS id, f.path AS file
FROM lineitem l JOIN files f ON f.n = l.l_partkey - l.l_partkey % 4 + l.l_orderkey % 4
"""

VIEWS["communities"] = """
SELECT CONCAT('repo', CAST(s_suppkey % 4 AS STRING)) AS repo_id, s_suppkey AS id,
  SPLIT_PART('bil-ling|user|Or-der|st-ock|report|nowhere', '|', CAST((s_suppkey - s_suppkey % 4) / 4 AS INT) % 6 + 1) AS name,
  CAST(ROUND(s_acctbal) AS INT) AS size
FROM supplier
"""

VIEWS["sources"] = """
SELECT f.n, f.repo_id, f.path, f.module, CONCAT('package ', f.pkg, ';', CHR(10), 'import java.util.List;', CHR(10),
  'import ', CASE WHEN a.n IS NULL THEN 'org.lost.Missing' ELSE CONCAT(a.pkg, '.', a.cls) END, ';', CHR(10),
  'import ', CASE WHEN b.n IS NULL THEN 'org.lost.Other' ELSE CONCAT(b.pkg, '.', b.cls) END, ';', CHR(10), '@Service', CHR(10), 'public class ', f.cls, ' {', CHR(10),
  '  // runs once', CHR(10), '  @Override', CHR(10), '  public int run(int x) {', CHR(10), '    if (x > ', CAST(f.n AS STRING), ') { return 0; }', CHR(10),
  '    return x.call(', CAST(f.n AS STRING), ');', CHR(10), '  }', CHR(10), '}') AS content
FROM files f LEFT JOIN files a ON a.n = f.n + 4 LEFT JOIN files b ON b.n = f.n + 44
"""

VIEWS["responses"] = """
SELECT l.doc_id AS response_id, f.repo_id, f.module AS module_name, f.path,
  CAST(l.doc_id % 90 AS INT) AS start_line, CAST(l.doc_id % 90 + l.quality AS INT) AS end_line, l.toxic,
  CONCAT('note', CHR(10), '```json', CHR(10), '{"comments":[{"path":"', f.path, '","content":"possible null value","startLine":',
  CAST(l.doc_id % 90 AS STRING), ',"endLine":', CAST(l.doc_id % 90 + l.quality AS STRING), ',"category":"', CASE WHEN l.toxic = 1 THEN 'SECURITY' ELSE '' END, '"}]}', CHR(10), '```') AS body
FROM labels l JOIN files f ON f.n = l.doc_id
"""

VIEWS["projects"] = """
SELECT CONCAT('P', CAST(s_suppkey AS STRING)) AS code, s_name AS name, s_acctbal > 0 AS active FROM supplier
"""

VIEWS["run_log"] = """
SELECT CONCAT('t', CAST(o_orderkey AS STRING)) AS task_id, CONCAT('P', CAST(o_custkey AS STRING)) AS project,
  o_orderstatus AS status, o_orderdate AS created_at, o_orderkey AS ord FROM orders
"""

_SERIES = re.compile(r"SERIES\(([^()]*), ([^()]*)\)")


def _names_in(sql: str) -> set[str]:
    words = set(re.findall(r"(?i)(?:from|join)\s+([a-z_]+)", sql))
    return words & set(VIEWS)


def _closure(sql: str) -> list[str]:
    need: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(_names_in(text)):
            if name not in need:
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    return need


def with_views(sql: str, *, engine: str = "duckdb", once: bool = False) -> str:
    """``sql`` with the views it reads written in front of it; ``once`` has each worked out a single time."""
    kept = "MATERIALIZED " if once else ""
    head = ", ".join(f"{n} AS {kept}({VIEWS[n].strip()})" for n in _closure(sql))
    body = sql.strip()
    if head:
        recursive = re.match(r"(?i)with\s+(recursive\s+)?", body)
        if recursive:
            word = "WITH RECURSIVE " if recursive.group(1) else "WITH "
            body = f"{word}{head}, {body[recursive.end():]}"
        else:
            body = f"WITH {head} {body}"
    to = r"EXPLODE(SEQUENCE(\1, \2))" if engine == "spark" else r"UNNEST(GENERATE_SERIES(\1, \2))"
    return _SERIES.sub(to, body)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in ``sf_dir``."""
    for base in BASE_TABLES:
        if re.search(rf"\b{base}\b", with_views(f"SELECT * FROM {name}")):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(with_views(f"SELECT * FROM {name}", engine="spark"))
