"""Queries over sources, graphs, review preparation, search and incremental reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions import dims, paths
from gitstrata.operators import callgraph as K
from gitstrata.operators import prep as P
from gitstrata.operators import search as Q
from gitstrata.operators import structure as G
from gitstrata.plans.finding_queries import CALLERS, RESOLVED, symbols
from gitstrata.plans.registry import query
from gitstrata.streaming import tracker as T

# ---- source facts and architecture graph

# Fixture sources: package, two imports besides java.util.List, one type, one method.
FACTS = r"""(SELECT s.n AS ord, s.repo_id, s.path, s.module, f.layer, f.cls, f.pkg, a.path AS path_a, a.module AS module_a, b.path AS path_b, b.module AS module_b,
  coalesce(a.pkg || '.' || a.cls, 'org.lost.Missing') AS imp_a, coalesce(b.pkg || '.' || b.cls, 'org.lost.Other') AS imp_b
 FROM sources s JOIN files f ON f.n = s.n LEFT JOIN files a ON a.n = s.n + 4 LEFT JOIN files b ON b.n = s.n + 44)"""
EDGES = f"""(SELECT repo_id, path AS source, module, layer, imp_a AS imp, path_a AS target, module_a AS target_module FROM {FACTS} WHERE path_a IS NOT NULL
 UNION ALL SELECT repo_id, path, module, layer, imp_b, path_b, module_b FROM {FACTS} WHERE path_b IS NOT NULL)"""


def facts(src):
    return G.facts(src.sources.withColumnRenamed("n", "ord"))


@query("source_facts", f"""
SELECT path, module, pkg AS package, 'java.util.List;' || imp_a || ';' || imp_b AS imports, cls AS types, 'run' AS methods, 'Service;Override' AS annotations FROM {FACTS}""")
def _(src):
    out = facts(src)
    flat = [F.array_join(c, ";").alias(c) for c in ("imports", "types", "methods", "annotations")]
    return out.select("path", "module", "package", *flat)


@query("external_dependency_count", f"SELECT repo_id, path, 2 AS external_dependencies FROM {FACTS}")
def _(src):
    return G.external_dependencies(facts(src))


@query("java_file_filter", "SELECT path FROM sources WHERE path LIKE '%.java' AND content <> ''")
def _(src):
    return G.java_files(src.sources).select("path")


FRAME = ", ".join(f"'{d}'" for d in dims.FRAMEWORK_DIRS)


@query("module_of_path", f"""
SELECT path, coalesce(list_filter(list_reverse(string_split(regexp_replace(path, '/[^/]*$', ''), '/')), lambda p: p <> '' AND lower(p) NOT IN ({FRAME}))[1], 'other') AS module FROM files""")
def _(src):
    return src.files.select("path", paths.module_of(F.col("path")).alias("module"))


@query("class_index", f"SELECT repo_id, pkg || '.' || cls AS fqcn, max_by(path, ord) AS target FROM {FACTS} GROUP BY ALL")
def _(src):
    return G.class_index(facts(src)).select("repo_id", "fqcn", "target")


@query("graph_nodes", f"""
SELECT path AS id, CASE layer WHEN 'controller' THEN 'controller' WHEN 'service' THEN 'service' WHEN 'dao' THEN 'dao' ELSE 'class' END AS type, split_part(path, '/', -1) AS name, 'MODIFY' AS change_type FROM {FACTS}""")
def _(src):
    return G.nodes(facts(src)).select("id", "type", "name", "change_type")


@query("import_edges", f"SELECT DISTINCT repo_id, source, target FROM {EDGES} WHERE source <> target")
def _(src):
    return G.import_edges(facts(src))


MODULES = f"(SELECT DISTINCT repo_id, module AS source, target_module AS target FROM {EDGES} WHERE module <> target_module)"


@query("module_dependency_edges", f"SELECT * FROM {MODULES}")
def _(src):
    return G.module_edges(facts(src))


CYCLES = f"""(WITH RECURSIVE e AS (SELECT * FROM {MODULES}),
 walk AS (SELECT repo_id, [source, target] AS p, target AS at FROM e WHERE source < target
  UNION ALL SELECT w.repo_id, list_append(w.p, e.target), e.target FROM walk w JOIN e ON e.repo_id = w.repo_id AND e.source = w.at WHERE e.target > w.p[1] AND NOT list_contains(w.p, e.target))
 SELECT w.repo_id, w.p AS modules FROM walk w JOIN e ON e.repo_id = w.repo_id AND e.source = w.at AND e.target = w.p[1])"""


@query("module_cycles", f"SELECT repo_id, array_to_string(modules, '>') AS cycle, len(modules) AS length FROM {CYCLES}")
def _(src):
    out = G.module_cycles(G.module_edges(facts(src)))
    return out.select("repo_id", F.array_join("modules", ">").alias("cycle"), "length")


REACHES = f"""(WITH RECURSIVE e AS (SELECT * FROM {MODULES}), r AS (SELECT repo_id, source, target FROM e
  UNION SELECT r.repo_id, r.source, e.target FROM r JOIN e ON e.repo_id = r.repo_id AND e.source = r.target)
 SELECT a.repo_id, a.source AS node, max(a.target) AS component FROM r a JOIN r b ON b.repo_id = a.repo_id AND b.source = a.target AND b.target = a.source GROUP BY 1, 2)"""
# Every cycle in each rotation closes the edge from its last module to its first: the least rotation is that edge's cycle.
SHORTEST = f"""(SELECT DISTINCT repo_id, cycle, length FROM (
 SELECT repo_id, array_to_string(modules, '>') AS cycle, len(modules) AS length, list_concat(modules[i:], modules[:i - 1]) AS turned
 FROM (SELECT *, unnest(generate_series(1, len(modules))) AS i FROM {CYCLES})
) QUALIFY row_number() OVER (PARTITION BY repo_id, turned[1], turned[length] ORDER BY length, turned) = 1)"""


@query("module_components", f"SELECT * FROM {REACHES}")
def _(src):
    return G.strong_components(G.module_edges(facts(src)))


@query("module_cycle_flags", f"SELECT repo_id, count(DISTINCT component) AS components, count(*) AS nodes FROM {REACHES} GROUP BY 1")
def _(src):
    return G.cycle_flags(G.module_edges(facts(src)))


@query("shortest_module_cycles", f"SELECT * FROM {SHORTEST}")
def _(src):
    return G.shortest_cycles(G.module_edges(facts(src))).select("repo_id", F.array_join("modules", ">").alias("cycle"), "length")


def evidence_sql(cycles):
    return f"""
WITH p AS (SELECT repo_id, cycle, string_split(cycle, '>') AS modules, unnest(generate_series(1, length)) AS i FROM {cycles}),
pairs AS (SELECT repo_id, cycle, modules[i] AS module, modules[i % len(modules) + 1] AS to_module FROM p),
hits AS (SELECT f.repo_id, f.path, f.module, t.module AS to_module, f.imp, arg_min(t.path, t.ord) AS target FROM
  (SELECT repo_id, path, module, imp_a AS imp FROM {FACTS} UNION SELECT repo_id, path, module, imp_b FROM {FACTS}) f
  JOIN {FACTS} t ON t.repo_id = f.repo_id AND starts_with(f.imp, t.pkg || '.') GROUP BY ALL)
SELECT q.repo_id, q.cycle, q.module, q.to_module, h.path AS source, min(h.imp) AS "import", h.target FROM pairs q
JOIN hits h ON h.repo_id = q.repo_id AND h.module = q.module AND h.to_module = q.to_module GROUP BY q.repo_id, q.cycle, q.module, q.to_module, h.path, h.target"""


@query("shortest_cycle_evidence", evidence_sql(SHORTEST))
def _(src):
    f = facts(src)
    return G.cycle_evidence(G.shortest_cycles(G.module_edges(f)), f)


@query("cycle_evidence", f"""
WITH p AS (SELECT repo_id, array_to_string(modules, '>') AS cycle, modules, unnest(generate_series(1, len(modules))) AS i FROM {CYCLES}),
pairs AS (SELECT repo_id, cycle, modules[i] AS module, modules[i % len(modules) + 1] AS to_module FROM p),
hits AS (SELECT f.repo_id, f.path, f.module, t.module AS to_module, f.imp, arg_min(t.path, t.ord) AS target FROM
  (SELECT repo_id, path, module, imp_a AS imp FROM {FACTS} UNION SELECT repo_id, path, module, imp_b FROM {FACTS}) f
  JOIN {FACTS} t ON t.repo_id = f.repo_id AND starts_with(f.imp, t.pkg || '.') GROUP BY ALL)
SELECT q.repo_id, q.cycle, q.module, q.to_module, h.path AS source, min(h.imp) AS "import", h.target FROM pairs q
JOIN hits h ON h.repo_id = q.repo_id AND h.module = q.module AND h.to_module = q.to_module GROUP BY q.repo_id, q.cycle, q.module, q.to_module, h.path, h.target""")
def _(src):
    f = facts(src)
    return G.cycle_evidence(G.module_cycles(G.module_edges(f)), f)


LAYERS = f"(SELECT repo_id, source, module, imp AS \"import\", target, target_module FROM {EDGES} WHERE layer = 'controller' AND contains(lower(target), 'dao'))"


@query("layer_violations", f"SELECT * FROM {LAYERS}")
def _(src):
    return G.layer_violations(facts(src))


@query("file_roles", f"""
SELECT repo_id, path, CASE layer WHEN 'controller' THEN 'web interface' WHEN 'service' THEN 'business logic' WHEN 'dao' THEN 'data access' WHEN 'model' THEN 'entity' ELSE 'utility' END AS role FROM {FACTS}""")
def _(src):
    return G.file_roles(facts(src))


DIRECT = "(SELECT DISTINCT repo_id, path FROM files WHERE layer = 'service')"
AFFECTED = f"""(SELECT repo_id, path, 'direct' AS reach FROM {DIRECT} UNION ALL
 SELECT repo_id, path, 'indirect' FROM (SELECT e.repo_id, e.target AS path FROM {EDGES} e JOIN {DIRECT} d ON d.repo_id = e.repo_id AND d.path = e.source
  UNION SELECT e.repo_id, e.source FROM {EDGES} e JOIN {DIRECT} d ON d.repo_id = e.repo_id AND d.path = e.target) n
 WHERE NOT EXISTS (SELECT 1 FROM {DIRECT} d WHERE d.repo_id = n.repo_id AND d.path = n.path))"""


def affected(src, f):
    return G.affected_files(G.import_edges(f), src.files.where("layer = 'service'"))


@query("affected_files", f"SELECT * FROM {AFFECTED}")
def _(src):
    return affected(src, facts(src))


@query("impact_scope", f"""
SELECT a.repo_id, a.direct_files, a.indirect_files, coalesce(c.n, 0) AS cycles, coalesce(v.n, 0) AS violations, CASE WHEN c.n > 0 THEN 'HIGH' WHEN v.n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT repo_id, count(*) FILTER (reach = 'direct') AS direct_files, count(*) FILTER (reach = 'indirect') AS indirect_files FROM {AFFECTED} GROUP BY 1) a
LEFT JOIN (SELECT repo_id, count(*) AS n FROM {CYCLES} GROUP BY 1) c USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM {LAYERS} GROUP BY 1) v USING (repo_id)""")
def _(src):
    f = facts(src)
    return G.impact_scope(affected(src, f), G.module_cycles(G.module_edges(f)), G.layer_violations(f))


@query("impact_scope_by_components", f"""
SELECT a.repo_id, a.direct_files, a.indirect_files, coalesce(c.n, 0) AS cycles, coalesce(v.n, 0) AS violations, CASE WHEN c.n > 0 THEN 'HIGH' WHEN v.n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT repo_id, count(*) FILTER (reach = 'direct') AS direct_files, count(*) FILTER (reach = 'indirect') AS indirect_files FROM {AFFECTED} GROUP BY 1) a
LEFT JOIN (SELECT repo_id, count(DISTINCT component) AS n FROM {REACHES} GROUP BY 1) c USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM {LAYERS} GROUP BY 1) v USING (repo_id)""")
def _(src):
    f = facts(src)
    components = G.strong_components(G.module_edges(f)).select("repo_id", "component").distinct()
    return G.impact_scope(affected(src, f), components, G.layer_violations(f))


@query("risk_signals", f"""
SELECT repo_id, 'cycle' AS kind, array_to_string(modules, ' > ') AS signal FROM {CYCLES} UNION SELECT repo_id, 'layer', source || ' > ' || target FROM {LAYERS}""")
def _(src):
    f = facts(src)
    return G.risk_signals(G.module_cycles(G.module_edges(f)), G.layer_violations(f))


# ---- call graph

ASKED = "(SELECT DISTINCT repo_id, qualified_name AS name FROM symbols WHERE module = 'user')"


def asked(src):
    return src.symbols.where("module = 'user'").select("repo_id", F.col("qualified_name").alias("name"))


@query("callers_of", f"SELECT e.repo_id, a.name, e.source AS neighbour FROM call_edges e JOIN {ASKED} a ON a.repo_id = e.repo_id AND a.name = e.target")
def _(src):
    return K.callers_of(src.call_edges, asked(src))


@query("callees_of", f"SELECT e.repo_id, a.name, e.target AS neighbour FROM call_edges e JOIN {ASKED} a ON a.repo_id = e.repo_id AND a.name = e.source")
def _(src):
    return K.callees_of(src.call_edges, asked(src))


@query("file_summary", "SELECT s.qualified_name, s.kind, s.file FROM symbols s WHERE s.file IN (SELECT path FROM files WHERE layer = 'dao')")
def _(src):
    return K.symbols_of_files(src.symbols, src.files.where("layer = 'dao'")).select("qualified_name", "kind", "file")


@query("capped_neighbours", """
SELECT repo_id, target AS name, source AS neighbour, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, target ORDER BY source) AS rank, count(*) OVER (PARTITION BY repo_id, target) AS total FROM call_edges) WHERE rank <= 5""")
def _(src):
    every = src.symbols.select("repo_id", F.col("qualified_name").alias("name"))
    return K.capped(src.call_edges, every)


DEGREE = "(SELECT repo_id, q AS qualified_name, count(*) AS degree FROM (SELECT repo_id, source AS q FROM call_edges UNION ALL SELECT repo_id, target FROM call_edges) GROUP BY ALL)"


def hubs_sql(n: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, qualified_name) AS rank FROM {DEGREE} QUALIFY rank <= {n})"


@query("hubs", f"SELECT repo_id, qualified_name, CAST(degree AS BIGINT) AS degree, rank FROM {hubs_sql(10)}")
def _(src):
    return K.hubs(src.call_edges)


@query("global_summary", f"""
SELECT repo_id, 'hub' AS kind, qualified_name AS name, CAST(degree AS DOUBLE) AS value FROM {hubs_sql(10)}
UNION ALL SELECT repo_id, 'flow', name, criticality FROM (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY criticality DESC, id) <= 5)
UNION ALL SELECT repo_id, 'community', name, CAST(size AS DOUBLE) FROM communities""")
def _(src):
    return K.global_summary(src.call_edges, src.flows, src.communities)


MHUBS = f"""(SELECT * FROM (SELECT h.repo_id, s.module, s.name, s.file, h.qualified_name, row_number() OVER (PARTITION BY h.repo_id, s.module ORDER BY h.degree DESC, h.qualified_name) AS rank
 FROM {DEGREE} h JOIN symbols s ON s.repo_id = h.repo_id AND s.qualified_name = h.qualified_name) WHERE rank <= 10)"""
EVERY_CALLER = f"""(SELECT h.repo_id, h.module, c.name AS caller, c.file AS caller_file, h.name AS callee, h.file AS callee_file,
  row_number() OVER (PARTITION BY h.repo_id, h.module ORDER BY h.rank, fn.ord, e.source) AS rn
 FROM {MHUBS} h JOIN symbols fn ON fn.repo_id = h.repo_id AND fn.file = h.file AND fn.kind = 'Function' AND contains(fn.qualified_name, h.name)
 JOIN call_edges e ON e.repo_id = fn.repo_id AND e.target = fn.qualified_name JOIN symbols c ON c.repo_id = e.repo_id AND c.qualified_name = e.source
 WHERE h.rank <= 5 AND c.module <> h.module)"""
EXTERNAL = f"(SELECT * FROM {EVERY_CALLER} WHERE rn <= 10)"
MFLOWS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, module ORDER BY criticality DESC, id) AS rank FROM
 (SELECT DISTINCT t.repo_id, f.module, t.id, t.name, t.criticality FROM flows t
  JOIN flow_files x ON x.repo_id = t.repo_id AND x.id = t.id JOIN files f ON f.repo_id = x.repo_id AND f.path = x.file)) WHERE rank <= 5)"""
# The same without bounds: callers into any symbol, every flow.
EVERY_ALL = """(SELECT t.repo_id, t.module, c.name AS caller, c.file AS caller_file, t.name AS callee, t.file AS callee_file
 FROM symbols t JOIN call_edges e ON e.repo_id = t.repo_id AND e.target = t.qualified_name AND t.kind = 'Function'
 JOIN symbols c ON c.repo_id = e.repo_id AND c.qualified_name = e.source WHERE c.module <> t.module)"""
FLOWS_ALL = MFLOWS.replace(" WHERE rank <= 5", "")


def unbounded(sql: str) -> str:
    return sql.replace(EVERY_CALLER, EVERY_ALL).replace(MFLOWS, FLOWS_ALL)


COMM = """(SELECT f.repo_id, f.module, arg_min(c.name, (-c.size, c.id)) AS community FROM files f JOIN communities c ON c.repo_id = f.repo_id AND contains(lower(f.path), replace(lower(c.name), '-', '')) GROUP BY ALL)"""


def modules(src):
    return src.files.select("repo_id", "module", "path")


@query("module_hubs", f"SELECT repo_id, module, name, file, rank FROM {MHUBS}")
def _(src):
    return K.module_hubs(src.call_edges, src.symbols, modules(src)).select("repo_id", "module", "name", "file", "rank")


@query("external_callers", f"SELECT repo_id, module, caller, caller_file, callee, callee_file FROM {EXTERNAL}")
def _(src):
    return K.external_callers(src.call_edges, src.symbols, modules(src), K.CALLED_HUBS, limit=10)


@query("external_callers_all", f"SELECT repo_id, module, caller, caller_file, callee, callee_file FROM {EVERY_CALLER}")
def _(src):
    return K.external_callers(src.call_edges, src.symbols, modules(src), K.CALLED_HUBS)


@query("flows_through_module", f"SELECT repo_id, module, id, name, rank FROM {MFLOWS}")
def _(src):
    return K.module_flows(src.flows, src.flow_files, modules(src), K.FLOWS).select("repo_id", "module", "id", "name", "rank")


@query("module_community", f"SELECT * FROM {COMM}")
def _(src):
    return K.module_community(src.communities, modules(src)).drop("size")


@query("path_match", """
SELECT f.repo_id, f.path AS left_path, g.p AS right_path FROM files f JOIN (SELECT repo_id, CASE WHEN n % 2 = 0 THEN replace(regexp_replace(path, '^src/main/java/', ''), '/', chr(92)) ELSE '/work/' || path END AS p, path FROM files) g
 ON g.repo_id = f.repo_id AND g.path = f.path""")
def _(src):
    f = src.files
    other = F.when(F.col("n") % 2 == 0, F.replace(F.regexp_replace("path", "^src/main/java/", ""), F.lit("/"), F.lit("\\"))).otherwise(
        F.concat(F.lit("/work/"), "path")
    )
    return paths.match_paths(f, f.select("repo_id", other.alias("path")))


SEEDS = "(SELECT DISTINCT repo_id, path FROM files WHERE module = 'auth' AND layer = 'dao')"
LINKS = """(SELECT DISTINCT e.repo_id, s.file AS a, t.file AS b FROM call_edges e JOIN symbols s ON s.repo_id = e.repo_id AND s.qualified_name = e.source
 JOIN symbols t ON t.repo_id = e.repo_id AND t.qualified_name = e.target WHERE s.file <> t.file)"""
BOTH = f"(SELECT repo_id, a, b FROM {LINKS} UNION SELECT repo_id, b, a FROM {LINKS})"


def links(src):
    return K.file_edges(src.call_edges, src.symbols)


@query("impact_radius_1", f"""
SELECT repo_id, file, min(hops) AS hops FROM (SELECT repo_id, path AS file, 0 AS hops FROM {SEEDS}
 UNION ALL SELECT l.repo_id, l.b, 1 FROM {BOTH} l JOIN {SEEDS} s ON s.repo_id = l.repo_id AND s.path = l.a) GROUP BY ALL""")
def _(src):
    return K.impact_radius(links(src), src.files.where("module = 'auth' AND layer = 'dao'"), 1)


@query("impact_radius_2", f"""
WITH l AS (SELECT * FROM {BOTH}), h0 AS (SELECT repo_id, path AS file FROM {SEEDS}), h1 AS (SELECT DISTINCT l.repo_id, l.b AS file FROM l JOIN h0 ON h0.repo_id = l.repo_id AND h0.file = l.a),
h2 AS (SELECT DISTINCT l.repo_id, l.b AS file FROM l JOIN h1 ON h1.repo_id = l.repo_id AND h1.file = l.a)
SELECT repo_id, file, min(hops) AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL""")
def _(src):
    return K.impact_radius(links(src), src.files.where("module = 'auth' AND layer = 'dao'"), 2)


CORE = f"""
WITH seeds AS (SELECT repo_id, module, file FROM {MHUBS} UNION SELECT repo_id, module, callee_file FROM {EVERY_CALLER}
 UNION SELECT m.repo_id, m.module, x.file FROM {MFLOWS} m JOIN flow_files x ON x.repo_id = m.repo_id AND x.id = m.id JOIN files f ON f.repo_id = m.repo_id AND f.module = m.module AND f.path = x.file),
core AS (SELECT * FROM seeds UNION SELECT s.repo_id, s.module, l.b FROM seeds s JOIN {BOTH} l ON l.repo_id = s.repo_id AND l.a = s.file)
SELECT f.repo_id, f.module, f.path AS file, CASE WHEN c.file IS NULL THEN 'edge' ELSE 'core' END AS part FROM files f LEFT JOIN core c ON c.repo_id = f.repo_id AND c.module = f.module AND c.file = f.path"""


@query("core_edge_split", CORE)
def _(src):
    return K.core_files(src.call_edges, src.symbols, modules(src), src.flows, src.flow_files, called_hubs=K.CALLED_HUBS, n_flows=K.FLOWS)


@query("core_edge_split_all", unbounded(CORE))
def _(src):
    return K.core_files(src.call_edges, src.symbols, modules(src), src.flows, src.flow_files)


TOTALS = f"""(SELECT f.repo_id, f.module, f.files, coalesce(x.n, 0) AS external_callers, CASE WHEN x.n > 0 THEN f.files // 3 ELSE 0 END AS high_impact_files
 FROM (SELECT repo_id, module, count(*) AS files FROM files GROUP BY ALL) f LEFT JOIN (SELECT repo_id, module, count(*) AS n FROM {EVERY_CALLER} GROUP BY ALL) x USING (repo_id, module))"""


@query("module_totals", f"SELECT * FROM {TOTALS}")
def _(src):
    m = modules(src)
    return K.module_totals(m, K.external_callers(src.call_edges, src.symbols, m, K.CALLED_HUBS))


@query("module_totals_all", f"SELECT * FROM {unbounded(TOTALS)}")
def _(src):
    m = modules(src)
    return K.module_totals(m, K.external_callers(src.call_edges, src.symbols, m))


@query("symbol_search", """
SELECT r.repo_id, r.symbol, s.qualified_name, s.candidate FROM (SELECT DISTINCT repo_id, symbol, split_part(symbol, '.', -1) AS method FROM findings) r
JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY ord) AS candidate FROM symbols WHERE kind = 'Function' QUALIFY candidate <= 15) s ON s.repo_id = r.repo_id AND s.name = r.method""")
def _(src):
    return K.symbol_candidates(src.symbols, src.findings, 15).select("repo_id", "symbol", "qualified_name", "candidate")


@query("symbol_resolution", f"SELECT * FROM {RESOLVED}")
def _(src):
    return K.resolve_symbols(src.symbols, src.findings)


@query("caller_facts", f"SELECT repo_id, target, callers, tx AS transactional FROM {CALLERS}")
def _(src):
    return K.caller_facts(src.call_edges, symbols(src))


SUMMARY = f"""
SELECT t.*, coalesce(h.n, 0) AS hubs, coalesce(w.n, 0) AS flows, c.community FROM {TOTALS} t
LEFT JOIN (SELECT repo_id, module, count(*) AS n FROM {MHUBS} GROUP BY ALL) h USING (repo_id, module) LEFT JOIN (SELECT repo_id, module, count(*) AS n FROM {MFLOWS} GROUP BY ALL) w USING (repo_id, module)
LEFT JOIN {COMM} c USING (repo_id, module)"""


@query("module_summary", SUMMARY)
def _(src):
    return K.module_summary(
        src.call_edges, src.symbols, modules(src), src.flows, src.flow_files, src.communities, called_hubs=K.CALLED_HUBS, n_flows=K.FLOWS
    )


@query("module_summary_all", unbounded(SUMMARY))
def _(src):
    return K.module_summary(src.call_edges, src.symbols, modules(src), src.flows, src.flow_files, src.communities)


# ---- review preparation

# One path per diff row: some of them are no code.
MIXED = """SELECT rid, repo_id, change_type, CASE WHEN rid % 5 = 0 THEN replace(path, '.java', '.YML') WHEN rid % 5 = 1 THEN '/deploy/' || path WHEN rid % 5 = 2 THEN replace(path, '.java', '.png') ELSE path END AS path FROM diffs"""


@query("file_prefilter", f"SELECT rid, path FROM ({MIXED}) WHERE rid % 5 > 2 AND change_type <> 'DELETE'")
def _(src):
    return P.reviewable(src.sql(MIXED.replace("'.YML'", "'.YML'"))).select("rid", "path")


NAMED = "SELECT n, repo_id, CASE WHEN n % 50 = 0 THEN CONCAT('svc', CAST(n AS STRING), '/src/A.java') ELSE path END AS path, module FROM files"


@query("review_groups", f"SELECT n, CASE WHEN n % 50 = 0 THEN 'small-modules' ELSE module END AS review_group FROM ({NAMED})")
def _(src):
    return P.review_groups(src.sql(NAMED)).select("n", "review_group")


FILE_DIFF = "(SELECT repo_id, path, 'diff --git ' || content AS unified_diff FROM sources)"


@query("cross_module_context", f"""
SELECT DISTINCT e.repo_id, e.module AS review_group, e.imp AS "import", e.target, d.unified_diff AS diff FROM {EDGES} e JOIN {FILE_DIFF} d ON d.repo_id = e.repo_id AND d.path = e.target WHERE e.module <> e.target_module""")
def _(src):
    groups = P.review_groups(src.files.select("repo_id", "path"))
    diffs = src.sources.select("repo_id", "path", F.concat(F.lit("diff --git "), "content").alias("unified_diff"))
    return P.cross_module_context(groups, facts(src), diffs, 2_000)


def cut_sql(c: str, n: int, note: str) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || {note} ELSE {c} END"


TOTAL = "chr(10) || '... [truncated, total ' || length(message) || ' chars]'"


@query("size_caps", f"""SELECT ord AS path, {cut_sql('message', 8000, TOTAL)} AS diff_part, {cut_sql('message', 4000, "chr(10) || '... [truncated]'")} AS content_part, {cut_sql('message', 6000, TOTAL)} AS edge_part FROM messages""")
def _(src):
    rows = src.messages.select("repo_id", F.col("ord").alias("path"), F.col("message").alias("content"), F.col("message").alias("unified_diff"))
    return P.size_caps(rows, diff=8_000, content=4_000, edge=6_000).drop("repo_id")


CHUNKS = """(WITH RECURSIVE s AS (SELECT repo_id, ord, least(length(message), 12000) AS size, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS i FROM messages),
 walk AS (SELECT repo_id, i, size AS used, 1 AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.repo_id, s.i, CASE WHEN w.used + s.size > 30000 THEN s.size ELSE w.used + s.size END, CASE WHEN w.used + s.size > 30000 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN s ON s.repo_id = w.repo_id AND s.i = w.i + 1)
 SELECT s.repo_id, s.ord, w.chunk FROM walk w JOIN s ON s.repo_id = w.repo_id AND s.i = w.i)"""


@query("greedy_chunks", f"SELECT repo_id, ord, chunk FROM {CHUNKS}")
def _(src):
    rows = src.messages.select("repo_id", "ord", F.col("message").alias("content"))
    return P.chunks(rows, ["repo_id"], cap=12_000).select("repo_id", "ord", F.col("chunk").cast("int").alias("chunk"))


@query("signature_summary", f"SELECT repo_id, path, path || ': ' || cls || ' → run' AS signature FROM {FACTS}")
def _(src):
    return P.signature_lines(facts(src))


SIGNED = f"""(WITH RECURSIVE s AS (SELECT repo_id, module, path, length(content) AS size, row_number() OVER (PARTITION BY repo_id, module ORDER BY n) AS i FROM sources),
 walk AS (SELECT repo_id, module, i, path, size AS used, 1 AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.repo_id, s.module, s.i, s.path, CASE WHEN w.used + s.size > 2000 THEN s.size ELSE w.used + s.size END, CASE WHEN w.used + s.size > 2000 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN s ON s.repo_id = w.repo_id AND s.module = w.module AND s.i = w.i + 1) SELECT * FROM walk)"""


@query("signatures_outside_chunk", f"""
SELECT a.repo_id, a.module, a.path, a.path || ': ' || f.cls || ' → run' AS signature FROM {SIGNED} a JOIN files f ON f.repo_id = a.repo_id AND f.path = a.path WHERE a.chunk <> 1""")
def _(src):
    rows = src.sources.select("repo_id", "module", "path", "content", F.col("n").alias("ord"))
    chunked = P.chunks(rows, ["repo_id", "module"], limit=2000, cap=2000)
    return P.signatures_outside(chunked, facts(src), 1).select("repo_id", "module", "path", "signature")


@query("method_signatures", "SELECT path, 0 AS pos, '@Override public int run(int x)' AS signature FROM sources")
def _(src):
    return P.method_signatures(src.sources).select("path", "pos", "signature")


LINES = "(SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, len(string_split(content, chr(10))) AS line_count FROM sources)"


@query("source_lines", f"SELECT repo_id, path, line_no, line, line_count, lpad(CAST(line_no AS STRING), 4, ' ') || ' | ' || line AS shown FROM {LINES}")
def _(src):
    return P.source_lines(src.sources.select("repo_id", "path", "content"))


# ---- search

@query("symbol_search_in_text", f"""
WITH l AS (SELECT * FROM {LINES}), h AS (SELECT * FROM l WHERE contains(line, 'x.call') QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) <= 30)
SELECT DISTINCT l.repo_id, l.path, l.line_no, l.line, contains(l.line, 'x.call') AS is_hit FROM l JOIN h ON h.repo_id = l.repo_id AND h.path = l.path AND l.line_no BETWEEN h.line_no - 5 AND h.line_no + 5""")
def _(src):
    return Q.search(src.sources, r"x\.call", 30)


@query("method_bodies", """
SELECT path, 'run' AS name, 8 + CAST(0 AS INT) AS line_no, 11 AS end_line,
 '  // runs once' || chr(10) || '  @Override' || chr(10) || '  public int run(int x) {' || chr(10) || '    if (x > ' || n || ') { return 0; }' || chr(10) || '    return x.call(' || n || ');' || chr(10) || '  }' || chr(10) AS text FROM sources""".replace("8 + CAST(0 AS INT)", "9").replace("11 AS end_line", "12 AS end_line"))
def _(src):
    return Q.methods(src.sources, 5_000).select("path", "name", "line_no", "end_line", "text")


# Requests: a finding's symbol in its own file, the same method of a class that is not in the graph, and text that occurs in no name.
WANTED = """SELECT repo_id, symbol, CAST(NULL AS STRING) AS path FROM findings WHERE candidate_handler IS NULL
 UNION SELECT repo_id, 'No.run', file FROM findings UNION SELECT repo_id, 'x.call', CAST(NULL AS STRING) FROM findings UNION SELECT repo_id, 'Q.return', CAST(NULL AS STRING) FROM findings UNION SELECT repo_id, 'zzz.zzz', CAST(NULL AS STRING) FROM findings"""


@query("search_ladder", f"""
WITH r AS (SELECT DISTINCT repo_id, symbol FROM ({WANTED})), g AS (SELECT * FROM {RESOLVED}),
t AS (SELECT r.repo_id, r.symbol, min(s.path) FILTER (contains(s.content, r.symbol)) AS whole, min(s.path) FILTER (contains(s.content, split_part(r.symbol, '.', -1))) AS bare FROM r JOIN sources s ON s.repo_id = r.repo_id GROUP BY ALL),
m AS (SELECT repo_id, symbol, min(path) AS path FROM ({WANTED}) w WHERE symbol = 'No.run' GROUP BY ALL)
SELECT r.repo_id, r.symbol, CASE WHEN g.target IS NOT NULL THEN 0 WHEN m.path IS NOT NULL THEN 1 WHEN t.whole IS NOT NULL THEN 2 WHEN t.bare IS NOT NULL THEN 3 END AS strategy, coalesce(g.target, m.path, t.whole, t.bare) AS where_found
FROM r LEFT JOIN g ON g.repo_id = r.repo_id AND g.symbol = r.symbol LEFT JOIN m ON m.repo_id = r.repo_id AND m.symbol = r.symbol LEFT JOIN t ON t.repo_id = r.repo_id AND t.symbol = r.symbol""")
def _(src):
    return Q.answer_requests(src.sql(WANTED), src.symbols, src.sources, Q.methods(src.sources))


# ---- incremental reads

NEWER = "(SELECT repo_id, branch, id, created_at, ord FROM commits WHERE created_at >= TIMESTAMP '1999-01-01')"


@query("advance_tracker", f"""
SELECT repo_id, branch, coalesce(n.id, t.last_hash) AS last_hash, coalesce(n.at, t.updated_at) AS updated_at FROM tracker t
FULL JOIN (SELECT repo_id, branch, arg_max(id, (created_at, ord)) AS id, max(created_at) AS at FROM {NEWER} GROUP BY ALL HAVING true) n USING (repo_id, branch)""")
def _(src):
    return T.advance(src.tracker, src.commits.where("created_at >= TIMESTAMP '1999-01-01'"))


@query("reset_tracker", "SELECT repo_id, branch, last_hash FROM tracker t WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.repo_id = t.repo_id AND replace(r.name, 'refs/remotes/origin/', '') = t.branch)")
def _(src):
    from gitstrata.sources.commits import branch_directory

    gone = branch_directory(src.refs).select("repo_id", F.col("name").alias("branch"))
    return T.reset(src.tracker, gone).select("repo_id", "branch", "last_hash")


BRANCHES = "(SELECT DISTINCT repo_id, branch FROM commits)"


def marks(src):
    return src.tracker.where("updated_at < TIMESTAMP '1998-01-01'")


@query("since_hash_lookup", f"""
SELECT b.repo_id, b.branch, t.last_hash AS since, t.last_hash IS NULL AS full_read FROM {BRANCHES} b LEFT JOIN tracker t ON t.repo_id = b.repo_id AND t.branch = b.branch AND t.updated_at < TIMESTAMP '1998-01-01'""")
def _(src):
    return T.since_hash(marks(src), src.commits.select("repo_id", "branch").distinct())


@query("incremental_read", """
SELECT c.repo_id, c.branch, c.id FROM commits c LEFT JOIN tracker t ON t.repo_id = c.repo_id AND t.branch = c.branch AND t.updated_at < TIMESTAMP '1998-01-01'
LEFT JOIN commits l ON l.repo_id = t.repo_id AND l.id = t.last_hash AND l.branch = t.branch WHERE l.id IS NULL OR (c.created_at, c.ord) > (l.created_at, l.ord)""")
def _(src):
    starts = T.since_hash(marks(src), src.commits.select("repo_id", "branch").distinct())
    return T.incremental(src.commits, starts).select("repo_id", "branch", "id")


# Two branches a repository: the newest commit, and a merge in the middle of the history.  A mark is a commit that was
# the tip before; dates of commits don't follow the history, so many unread commits are older than the mark.
TIPS = """
SELECT repo_id, 'main' AS branch, MAX(id) AS tip, LPAD(CAST(MAX(ord) - MAX(ord) % 100 - 300 + MAX(ord % 4) AS STRING), 8, '0') AS marked FROM commits GROUP BY repo_id
UNION ALL
SELECT repo_id, 'topic' AS branch, MAX(CASE WHEN parent2 IS NOT NULL AND ord < half THEN id END) AS tip,
  CASE WHEN repo_id = 'repo3' THEN 'nowhere' WHEN repo_id <> 'repo1' THEN LPAD(CAST(200 + MAX(ord % 4) AS STRING), 8, '0') END AS marked
FROM (SELECT *, (SELECT MAX(o_orderkey) / 2 FROM orders) AS half FROM commits) c GROUP BY repo_id
"""


@query("incremental_by_reachability", f"""
WITH RECURSIVE ends AS ({TIPS}),
links AS (SELECT repo_id, id, parent1 AS p FROM commits WHERE parent1 IS NOT NULL UNION ALL SELECT repo_id, id, parent2 FROM commits WHERE parent2 IS NOT NULL),
inside AS (SELECT repo_id, branch, tip AS id FROM ends UNION SELECT i.repo_id, i.branch, l.p FROM inside i JOIN links l ON l.repo_id = i.repo_id AND l.id = i.id),
outside AS (SELECT repo_id, branch, marked AS id FROM ends WHERE marked IS NOT NULL UNION SELECT i.repo_id, i.branch, l.p FROM outside i JOIN links l ON l.repo_id = i.repo_id AND l.id = i.id)
SELECT i.repo_id, i.branch, i.id FROM inside i JOIN commits c ON c.repo_id = i.repo_id AND c.id = i.id WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.repo_id = i.repo_id AND o.branch = i.branch AND o.id = i.id)""")
def _(src):
    ends = src.sql(TIPS)
    starts = T.since_hash(ends.select("repo_id", "branch", F.col("marked").alias("last_hash")), ends)
    commits = src.commits.withColumn("parent_ids", F.array_compact(F.array("parent1", "parent2")))
    return T.unread(commits, starts, ends).select("repo_id", "branch", "id")
