"""Questions about a call graph of many repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.grams import containing
from gitstrata.functions.scale import Rounds, cut

HUBS, FLOWS, CALLED_HUBS = 10, 5, 5  # how many a report shows; HUBS also says what a module's hub is


def _top(df: DataFrame, keys: list[str], order: list[Column], n: int | None, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key; limited before the shuffle too, so a hot key stays small.  All, without a rank, for None."""
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def numbers(names: DataFrame, column: str) -> DataFrame:
    """(repo_id, column, _n): every different name of a repository with a number; numbers stand in the order of the names."""
    ordered = names.select("repo_id", column).where(F.col(column).isNotNull()).distinct()
    ordered = ordered.repartitionByRange(column, "repo_id").sortWithinPartitions(column, "repo_id")
    return Rounds(names.sparkSession).lay(ordered.withColumn("_n", F.monotonically_increasing_id()))


def numbered(df: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """``df`` with numbers of ``known`` for the names in ``columns``; null for a name without one."""
    name = known.columns[1]
    for c in columns:
        df = df.join(known.withColumnRenamed(name, c), ["repo_id", c], "left").select(
            *[F.col("_n").alias(k) if k == c else F.col(k) for k in df.columns]
        )
    return df


def numbered_calls(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and symbols with numbers for qualified names, in the order of the names, so that long names are shuffled once.

    The edges are written, as questions on modules read them several times; ``full_name`` of
    the symbols is the name itself.
    """
    known = numbers(symbols, "qualified_name")
    narrow = Rounds(edges.sparkSession).lay(numbered(edges.select("repo_id", "source", "target"), known, "source", "target"))
    return narrow, numbered(symbols.withColumn("full_name", F.col("qualified_name")), known, "qualified_name")


def callers_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(repo_id, name) → one row per caller."""
    n = names.select("repo_id", F.col("name").alias("target")).distinct()
    return edges.join(n, ["repo_id", "target"]).select("repo_id", F.col("target").alias("name"), F.col("source").alias("neighbour"))


def callees_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    n = names.select("repo_id", F.col("name").alias("source")).distinct()
    return edges.join(n, ["repo_id", "source"]).select("repo_id", F.col("source").alias("name"), F.col("target").alias("neighbour"))


def symbols_of_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("repo_id", F.col("path").alias("file")).distinct(), ["repo_id", "file"], "left_semi")


def capped(edges: DataFrame, names: DataFrame, n: int = 5, *, callers: bool = True) -> DataFrame:
    """The first ``n`` callers (or callees) of each name and how many there are in all.

    Edges are limited and counted before the names are joined, so the edges of a
    node with very many callers never meet in one task.
    """
    node, other = ("target", "source") if callers else ("source", "target")
    rows = edges.select("repo_id", F.col(node).alias("name"), F.col(other).alias("neighbour"))
    total = rows.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("total"))
    first = _top(rows, ["repo_id", "name"], [F.col("neighbour")], n)
    asked = names.select("repo_id", "name").distinct()
    return first.join(total, ["repo_id", "name"]).join(asked, ["repo_id", "name"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree; each edge end is counted before the two are added."""
    out = edges.groupBy("repo_id", F.col("source").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n"))
    inn = edges.groupBy("repo_id", F.col("target").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(inn).groupBy("repo_id", "qualified_name").agg(F.sum("n").alias("degree"))


def hubs(edges: DataFrame, n: int = HUBS) -> DataFrame:
    return _top(degrees(edges), ["repo_id"], [F.col("degree").desc(), F.col("qualified_name")], n)


def top_flows(flows: DataFrame, n: int = FLOWS) -> DataFrame:
    return _top(flows, ["repo_id"], [F.col("criticality").desc(), F.col("id")], n)


def global_summary(edges: DataFrame, flows: DataFrame, communities: DataFrame) -> DataFrame:
    """Hubs, flows by criticality and all communities by size, as (kind, name, value)."""
    parts = [
        hubs(edges).select("repo_id", F.lit("hub").alias("kind"), F.col("qualified_name").alias("name"), F.col("degree").cast("double").alias("value")),
        top_flows(flows).select("repo_id", F.lit("flow"), "name", F.col("criticality").cast("double")),
        communities.select("repo_id", F.lit("community"), "name", F.col("size").cast("double")),
    ]
    return reduce(DataFrame.union, parts)


def module_hubs(edges: DataFrame, symbols: DataFrame, modules: DataFrame, n: int | None = HUBS) -> DataFrame:
    """The first n hubs of every module, however small beside other modules; every called or calling symbol for None.

    ``modules`` has (repo_id, module, path).
    """
    where = symbols.select("repo_id", "qualified_name", "name", "file")
    of = modules.select("repo_id", F.col("path").alias("file"), "module")
    located = degrees(edges).join(where, ["repo_id", "qualified_name"]).join(of, ["repo_id", "file"])
    return _top(located, ["repo_id", "module"], [F.col("degree").desc(), F.col("qualified_name")], n)


def external_callers(
    edges: DataFrame, symbols: DataFrame, modules: DataFrame, n: int | None = None, limit: int | None = None
) -> DataFrame:
    """Callers from outside a module, into any symbol or its first n hubs; all of them, or the first ``limit`` per module."""
    top = module_hubs(edges, symbols, modules, n)
    full = "full_name" if "full_name" in symbols.columns else "qualified_name"
    functions = symbols.where(F.col("kind") == "Function").select(
        "repo_id", "file", F.col("qualified_name").alias("target"), F.col(full).alias("_full"), F.col("ord").alias("_fn")
    )
    entry = top.select(
        "repo_id", "module", "degree", F.col("qualified_name").alias("_hub"), "file", F.col("name").alias("callee")
    ).join(functions, ["repo_id", "file"])
    # Names find a hub's functions by a part; where every symbol is asked for, each finds itself.
    entry = entry.where(F.col("target") == F.col("_hub") if n is None else F.col("_full").contains(F.col("callee")))
    homes = modules.select("repo_id", F.col("path").alias("caller_file"), F.col("module").alias("_home"))
    files = symbols.select(
        "repo_id", F.col("qualified_name").alias("source"), F.col("name").alias("caller"), F.col("file").alias("caller_file")
    ).join(homes, ["repo_id", "caller_file"], "left")
    calls = edges.select("repo_id", "source", "target").join(entry, ["repo_id", "target"]).join(files, ["repo_id", "source"])
    outside = calls.where(F.coalesce(F.col("_home"), F.lit("")) != F.col("module"))
    order = [F.col("degree").desc(), F.col("_hub"), F.col("_fn"), F.col("source")]
    picked = outside if limit is None else _top(outside, ["repo_id", "module"], order, limit, "_rn")
    return picked.select("repo_id", "module", "caller", "caller_file", "callee", F.col("file").alias("callee_file"))


def module_flows(flows: DataFrame, flow_files: DataFrame, modules: DataFrame, n: int | None = None) -> DataFrame:
    """The flows that touch a module, for every module: all, or the n most critical."""
    facts = flows.select("repo_id", "id", "name", "criticality").distinct()
    of = modules.select("repo_id", F.col("path").alias("file"), "module")
    on = flow_files.join(of, ["repo_id", "file"]).select("repo_id", "module", "id").distinct()
    touched = on.join(facts, ["repo_id", "id"]).select("repo_id", "module", "id", "name", "criticality")
    return _top(touched, ["repo_id", "module"], [F.col("criticality").desc(), F.col("id")], n)


def module_community(communities: DataFrame, modules: DataFrame) -> DataFrame:
    """Largest community whose name (lower case, no dashes) occurs in a path of the module."""
    c = communities.select("repo_id", "id", "name", "size", F.replace(F.lower("name"), F.lit("-"), F.lit("")).alias("word"))
    texts = modules.select("repo_id", "module", "path", F.lower("path").alias("body"))
    found = containing(texts, c, ["repo_id"], ["module", "path"]).select("repo_id", "module", "word").distinct()
    hits = found.join(c, ["repo_id", "word"])
    best = F.struct(-F.col("size"), F.col("id"))
    return hits.groupBy("repo_id", "module").agg(F.min_by("name", best).alias("community"), F.max("size").alias("size"))


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """File pairs connected by a call, in both directions."""
    f = symbols.select("repo_id", "qualified_name", "file")
    pairs = (
        edges.join(f.select("repo_id", F.col("qualified_name").alias("source"), F.col("file").alias("a")), ["repo_id", "source"])
        .join(f.select("repo_id", F.col("qualified_name").alias("target"), F.col("file").alias("b")), ["repo_id", "target"])
        .where(F.col("a") != F.col("b")).select("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return pairs.select("repo_id", both).select("repo_id", "e.a", "e.b")


def impact_radius(links: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Files at most ``depth`` hops from the seeds, with their distance.

    Only the newest frontier is joined, and each step is cut off.  With more steps than one
    the links are written first, or every step would work them out anew.
    """
    if depth > 1:
        links = Rounds(links.sparkSession).lay(links)
    seen = seeds.select("repo_id", F.col("path").alias("file")).distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = links.join(frontier.select("repo_id", F.col("file").alias("a")), ["repo_id", "a"]).select("repo_id", F.col("b").alias("file")).distinct()
        frontier = step.join(seen, ["repo_id", "file"], "left_anti").withColumn("hops", F.lit(d))
        if d < depth:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
        if d < depth:
            seen = cut(seen)
    return seen


def core_files(
    edges, symbols, modules, flows, flow_files, n_hubs: int | None = HUBS, called_hubs: int | None = None, n_flows: int | None = None
) -> DataFrame:
    """Every module file, marked core or edge; all are core where a repository has no call graph.

    Core: holds a hub, is called from outside, lies on a flow, or is one hop from such a file.  Hubs are
    the first ``n_hubs``, as with all of them any call makes a file core; callers and flows have no bound.
    Names of symbols and files stand as numbers until the end.
    """
    k = ["repo_id", "module", "file"]
    if flows_all := n_flows is None:
        # A file on any flow is one; the flows of its module need not be told apart.
        on_flow = flow_files.join(flows.select("repo_id", "id"), ["repo_id", "id"], "left_semi").select("repo_id", "file").distinct()
    else:
        picked = module_flows(flows, flow_files, modules, n_flows).select("repo_id", "module", "id")
        on_flow = picked.join(flow_files, ["repo_id", "id"]).select(*k).distinct()
    paths = numbers(modules, "path")
    files = paths.withColumnRenamed("path", "file")
    edges, symbols = numbered_calls(edges, symbols)
    symbols, on_flow = numbered(symbols, files, "file"), numbered(on_flow, files, "file")
    modules = numbered(modules.withColumn("_name", F.col("path")), paths, "path")
    of = modules.select("repo_id", "module", F.col("path").alias("file"))
    seeds = cut(
        module_hubs(edges, symbols, modules, n_hubs).select(*k)
        .union(external_callers(edges, symbols, modules, called_hubs).select("repo_id", "module", F.col("callee_file").alias("file")))
        .union(on_flow.join(of, ["repo_id", "file"] if flows_all else k).select(*k))
        .distinct()
    )
    graphs = edges.select("repo_id").distinct().withColumn("_graph", F.lit(True))
    near = file_edges(edges, symbols).withColumnRenamed("a", "file").join(seeds, ["repo_id", "file"]).select("repo_id", "module", F.col("b").alias("file"))
    core = seeds.union(near).distinct().withColumn("_core", F.lit(True))
    # A repository without a call graph can't be split: all its files are core.
    all_files = modules.select("repo_id", "module", F.col("path").alias("file"), "_name").join(graphs, "repo_id", "left")
    return all_files.join(core, k, "left").select(
        "repo_id", "module", F.col("_name").alias("file"), F.when(F.col("_core") | F.col("_graph").isNull(), "core").otherwise("edge").alias("part")
    )


def module_totals(modules: DataFrame, callers: DataFrame) -> DataFrame:
    files = modules.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("files"))
    ext = callers.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("external_callers"))
    return files.join(ext, ["repo_id", "module"], "left").fillna(0, ["external_callers"]).withColumn(
        "high_impact_files", F.when(F.col("external_callers") > 0, F.expr("files div 3")).otherwise(0)
    )


def module_summary(
    edges, symbols, modules, flows, flow_files, communities,
    n_hubs: int | None = HUBS, called_hubs: int | None = None, n_flows: int | None = None,
) -> DataFrame:
    """One row per module: files, hubs (of the first ``n_hubs``), external callers, flows and community."""
    k = ["repo_id", "module"]
    edges, symbols = numbered_calls(edges, symbols)
    h = module_hubs(edges, symbols, modules, n_hubs).groupBy(*k).agg(F.count(F.lit(1)).alias("hubs"))
    f = module_flows(flows, flow_files, modules, n_flows).groupBy(*k).agg(F.count(F.lit(1)).alias("flows"))
    return (
        module_totals(modules, external_callers(edges, symbols, modules, called_hubs))
        .join(h, k, "left").join(f, k, "left").join(module_community(communities, modules), k, "left")
        .fillna(0, ["hubs", "flows"]).drop("size")
    )


def method_candidates(symbols: DataFrame, requests: DataFrame, n: int | None = None) -> DataFrame:
    """Functions of every requested method name, once per (repo, method): all, or the first ``n`` in input order.

    Rows grow with methods and functions, whatever number of classes ask for one method.
    ``candidate`` is the rank with ``n``, else the ``ord``.
    """
    methods = split_symbol(requests).select("repo_id", F.col("method").alias("name")).distinct()
    functions = symbols.where(F.col("kind") == "Function").join(methods, ["repo_id", "name"], "left_semi")
    found = functions.withColumn("candidate", F.col("ord")) if n is None else _top(functions, ["repo_id", "name"], [F.col("ord")], n, "candidate")
    return found.withColumnRenamed("name", "method")


def symbol_candidates(symbols: DataFrame, requests: DataFrame, n: int | None = None) -> DataFrame:
    """Functions with the method name of each requested symbol, in input order: all, or the first ``n``.

    The result holds a row per symbol and candidate; ``method_candidates`` has each candidate
    once, and ``resolve_symbols`` needs neither.
    """
    return split_symbol(requests).join(method_candidates(symbols, requests, n), ["repo_id", "method"])


def split_symbol(requests: DataFrame) -> DataFrame:
    """Distinct (repo_id, symbol) with class part (null without a dot) and method part."""
    s = requests.select("repo_id", "symbol").where("symbol <> ''").distinct()
    return s.withColumn("cls", F.when(F.col("symbol").contains("."), F.regexp_replace("symbol", r"\.[^.]*$", ""))).withColumn(
        "method", F.substring_index("symbol", ".", -1)
    )


def suffix_index(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo_id, symbol, target): of the functions whose qualified name ends with a symbol, the first by ``ord``.

    A function is entered once for every length of symbol that is asked of its method, under
    the end of its name of that length, so requests meet their function by equality.
    """
    lengths = asked.select("repo_id", "method", F.length("symbol").alias("_len")).distinct()
    ends = functions.select("repo_id", F.col("name").alias("method"), "qualified_name", "ord").join(lengths, ["repo_id", "method"])
    ends = ends.where(F.length("qualified_name") >= F.col("_len")).withColumn("symbol", F.expr("right(qualified_name, _len)"))
    first = ends.groupBy("repo_id", "method", "symbol").agg(F.min_by("qualified_name", F.struct("ord", "qualified_name")).alias("target"))
    return asked.select("repo_id", "method", "symbol").join(first, ["repo_id", "method", "symbol"]).select("repo_id", "symbol", "target")


def resolve_symbols(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """``Class.method`` to a graph node: by ending, then by class in path or name; bare names take the first.

    Endings are found through ``suffix_index``.  Only what it leaves looks for functions of the
    method whose path or name holds the class part, by its rarest token; no request meets all
    functions of its name.
    """
    asked = split_symbol(requests)
    functions = symbols.where((F.col("kind") == "Function") & F.col("qualified_name").isNotNull())
    order = F.struct("ord", "qualified_name")
    firsts = functions.groupBy("repo_id", F.col("name").alias("method")).agg(F.min_by("qualified_name", order).alias("target"))
    bare = asked.where("cls IS NULL").join(firsts, ["repo_id", "method"]).select("repo_id", "symbol", "target")
    whole = asked.where("cls IS NOT NULL")
    ended = cut(whole.join(suffix_index(functions, whole), ["repo_id", "symbol"], "left").select("repo_id", "symbol", "cls", "method", "target"))
    by_end = ended.where("target IS NOT NULL").select("repo_id", "symbol", "target")
    rest = ended.where("target IS NULL").drop("target")
    named = functions.withColumnRenamed("name", "method").join(rest.select("repo_id", "method").distinct(), ["repo_id", "method"], "left_semi")
    named = named.where(F.col("qualified_name").contains(F.concat(F.lit("."), F.col("method"))))
    side = lambda k, c: named.select("repo_id", "method", "qualified_name", "ord", F.lit(k).alias("_side"), F.col(c).alias("body"))
    texts = side(0, "qualified_name").union(side(1, "file").where("body IS NOT NULL"))
    words = rest.select("repo_id", "method", F.col("cls").alias("word"))
    held = containing(texts, words, ["repo_id", "method"], ["qualified_name", "ord", "_side"])
    loose = held.groupBy("repo_id", "method", F.col("word").alias("cls")).agg(F.min_by("qualified_name", order).alias("target"))
    any_ = named.groupBy("repo_id", "method").agg(F.min_by("qualified_name", order).alias("target")).withColumn("cls", F.lit(""))
    loose = loose.unionByName(any_)
    return by_end.union(bare).union(rest.join(loose, ["repo_id", "method", "cls"]).select("repo_id", "symbol", "target"))


def caller_facts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per called node: number of callers and whether one of them is transactional."""
    marks = symbols.select("repo_id", F.col("qualified_name").alias("source"), F.array_contains("annotations", "Transactional").alias("_tx"))
    return edges.join(marks, ["repo_id", "source"], "left").groupBy("repo_id", "target").agg(
        F.count(F.lit(1)).alias("callers"), F.coalesce(F.max("_tx"), F.lit(False)).alias("transactional")
    )
