"""Source facts and the architecture graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import dims, paths
from gitstrata.functions.scale import Rounds, cut


def _all(pattern: str) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(1))


def java_files(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("path").endswith(".java") & (F.coalesce("content", F.lit("")) != ""))


def facts(sources: DataFrame) -> DataFrame:
    """Package, imports, types, methods and annotations; the text itself is dropped."""
    package = F.regexp_extract("content", dims.PACKAGE_PATTERN, 1)
    return java_files(sources).select(
        *[c for c in sources.columns if c not in ("content", "module")],
        paths.module_of(F.col("path")).alias("module"),
        F.when(package != "", package).alias("package"),
        _all(dims.IMPORT_PATTERN).alias("imports"),
        _all(dims.TYPE_PATTERN).alias("types"),
        _all(dims.METHOD_PATTERN).alias("methods"),
        _all(dims.ANNOTATION_PATTERN).alias("annotations"),
    )


def external_dependencies(facts: DataFrame) -> DataFrame:
    outside = F.filter("imports", lambda i: ~(i.startswith("java.") | i.startswith("javax.")))
    return facts.select("repo_id", "path", F.size(outside).alias("external_dependencies"))


def nodes(files: DataFrame) -> DataFrame:
    change = F.coalesce("change_type", F.lit("MODIFY")) if "change_type" in files.columns else F.lit("MODIFY")
    return files.select(
        "repo_id", F.col("path").alias("id"), paths.node_type(F.col("path")).alias("type"),
        paths.file_name(F.col("path")).alias("name"), change.alias("change_type"), "package",
    )


def class_index(facts: DataFrame, order: str = "ord") -> DataFrame:
    """Full type name to file; the last file in order wins."""
    types = facts.where("package IS NOT NULL").select("repo_id", "package", "path", "module", order, F.explode("types").alias("t"))
    return types.groupBy("repo_id", F.concat_ws(".", "package", "t").alias("fqcn")).agg(
        F.max_by("path", F.struct(order, "path")).alias("target"),
        F.max_by("module", F.struct(order, "path")).alias("target_module"),
    )


def usable_imports(facts: DataFrame, jdk: list[str] = dims.JDK_PREFIXES) -> DataFrame:
    rows = facts.select("repo_id", "path", "module", F.explode("imports").alias("import"))
    platform = F.lit(False)
    for p in jdk:
        platform = platform | F.col("import").startswith(p)
    return rows.where(~platform & F.col("import").contains("."))


def resolved_imports(facts: DataFrame, order: str = "ord") -> DataFrame:
    index = class_index(facts, order).withColumnRenamed("fqcn", "import")
    return usable_imports(facts).join(index, ["repo_id", "import"])


def import_edges(facts: DataFrame, order: str = "ord") -> DataFrame:
    return (
        resolved_imports(facts, order).where(F.col("path") != F.col("target"))
        .select("repo_id", F.col("path").alias("source"), "target").distinct()
    )


def module_edges(facts: DataFrame, order: str = "ord") -> DataFrame:
    return (
        resolved_imports(facts, order).where(F.col("module") != F.col("target_module"))
        .select("repo_id", F.col("module").alias("source"), F.col("target_module").alias("target")).distinct()
    )


def module_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """All simple cycles of the module graph, each starting at its smallest module.

    A path grows only to modules larger than its start and not yet on it, so every
    cycle is met once and in one rotation.  Edges that leave or enter a dead end
    are trimmed first.  The loop stops when no path is left; ``max_len`` stops it
    earlier.  A dense graph has exponentially many simple cycles: ``shortest_cycles``
    and ``cycle_flags`` stay polynomial.
    """
    live = _on_cycles(edges.select("repo_id", "source", "target").distinct())
    e = live.select("repo_id", F.col("source").alias("at"), F.col("target").alias("to"))
    path = e.where("at < to").select("repo_id", F.array("at", "to").alias("modules"), F.col("to").alias("at"))
    found = None
    length = 2
    while max_len is None or length <= max_len:
        step = cut(path.join(e, ["repo_id", "at"]))
        start = F.element_at("modules", 1)
        closed = step.where(F.col("to") == start).select("repo_id", "modules")
        found = closed if found is None else found.union(closed)
        path = step.where((F.col("to") > start) & ~F.array_contains("modules", F.col("to"))).select(
            "repo_id", F.concat("modules", F.array("to")).alias("modules"), F.col("to").alias("at")
        )
        length += 1
        if path.isEmpty():
            break
    return found.select("repo_id", "modules", F.size("modules").alias("length"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo_id, node, component) of every node on a cycle; component is the greatest node of its component.

    Forward-backward colouring: the greatest name that reaches a node is its colour, and the
    nodes of a colour that lead back to the node of that name are one component.  Nodes
    without edges in or out are trimmed before every turn; what is left after a turn takes the
    next.  A node with an edge to itself counts as a cycle.  Null ends are ignored.
    """
    lists = [Rounds(edges.sparkSession) for _ in range(4)]
    pair = edges.select("repo_id", "source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    live = cut(pair)
    done = live.where("source = target").select("repo_id", F.col("source").alias("node"), F.col("source").alias("component"))
    live = live.where("source <> target")
    while True:
        live = _on_cycles(live)
        if live.isEmpty():
            return done.distinct().groupBy("repo_id", "node").agg(F.max("component").alias("component"))
        colour = cut(live.select("repo_id", F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        fresh = colour
        while True:  # only nodes whose colour has changed hand it on
            offers = live.join(fresh.withColumnRenamed("node", "source"), ["repo_id", "source"]).groupBy("repo_id", F.col("target").alias("node")).agg(F.max("colour").alias("_new"))
            fresh = lists[0].lay(offers.join(colour, ["repo_id", "node"]).where("_new > colour").select("repo_id", "node", F.col("_new").alias("colour")))
            if fresh.isEmpty():
                break
            colour = lists[1].lay(colour.union(fresh).groupBy("repo_id", "node").agg(F.max("colour").alias("colour")))
        of = lambda end: colour.select("repo_id", F.col("node").alias(end), F.col("colour").alias(f"_{end}"))
        inside = cut(live.join(of("source"), ["repo_id", "source"]).join(of("target"), ["repo_id", "target"]).where("_source = _target").select(
            "repo_id", "source", "target", F.col("_source").alias("colour")
        ))
        back = cut(colour.where("node = colour").select("repo_id", "node"))
        fresh = back
        while True:
            steps = inside.join(fresh.withColumnRenamed("node", "target"), ["repo_id", "target"]).select("repo_id", F.col("source").alias("node")).distinct()
            fresh = lists[2].lay(steps.join(back, ["repo_id", "node"], "left_anti"))
            if fresh.isEmpty():
                break
            back = lists[3].lay(back.union(fresh))
        found = cut(back.join(colour, ["repo_id", "node"]))
        many = found.groupBy("repo_id", "colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        done = cut(done.union(found.join(many, ["repo_id", "colour"]).select("repo_id", "node", F.col("colour").alias("component"))))
        gone = found.select("repo_id", "node")
        live = live.join(gone.withColumnRenamed("node", "source"), ["repo_id", "source"], "left_anti")
        live = live.join(gone.withColumnRenamed("node", "target"), ["repo_id", "target"], "left_anti").select("repo_id", "source", "target")


def _on_cycles(live: DataFrame) -> DataFrame:
    """Edges left after those that leave or enter a dead end have gone, round by round."""
    live = cut(live)
    size = live.count()
    while True:
        heads = live.select("repo_id", F.col("source").alias("target")).distinct()
        tails = live.select("repo_id", F.col("target").alias("source")).distinct()
        live = cut(live.join(heads, ["repo_id", "target"], "left_semi").join(tails, ["repo_id", "source"], "left_semi").select("repo_id", "source", "target"))
        now = live.count()
        if now == size:
            return live
        size = now


def cycle_flags(edges: DataFrame) -> DataFrame:
    """Per repository with a cycle: how many components hold one, and how many nodes lie on one; nothing is listed."""
    return strong_components(edges).groupBy("repo_id").agg(
        F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("nodes")
    )


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """For every edge inside a component a shortest cycle through it, each cycle once, from its smallest module.

    Of equally short ways back the first in the order of names is taken, so the result is
    determined.  A component of n modules gives no more cycles than it has edges, and no more
    than n * n ways are held, where listing all cycles could take exponentially many.
    """
    home = strong_components(edges)
    of = lambda end: home.select("repo_id", F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    inside = edges.select("repo_id", "source", "target").distinct().join(of("source"), ["repo_id", "source"]).join(of("target"), ["repo_id", "target"])
    inside = cut(inside.where("_source = _target").select("repo_id", "source", "target"))
    step = inside.select("repo_id", F.col("source").alias("at"), F.col("target").alias("to"))
    # An edge u -> v is closed by a way from v back to u: ways grow from v until all such u are met.
    wanted = inside.select("repo_id", F.col("target").alias("start"), F.col("source").alias("at"))
    ways = cut(wanted.select("repo_id", "start").distinct().select("repo_id", "start", F.col("start").alias("at"), F.array("start").alias("modules")))
    seen, found = ways.select("repo_id", "start", "at"), None
    lists = [Rounds(edges.sparkSession) for _ in range(4)]
    while True:
        hits = ways.join(wanted, ["repo_id", "start", "at"]).select("repo_id", "modules")
        found = lists[0].lay(hits if found is None else found.union(hits))
        wanted = lists[1].lay(wanted.join(ways, ["repo_id", "start", "at"], "left_anti"))
        open_ = wanted.select("repo_id", "start").distinct()
        if open_.isEmpty():
            break
        grown = ways.join(open_, ["repo_id", "start"], "left_semi").join(step, ["repo_id", "at"])
        best = grown.groupBy("repo_id", "start", F.col("to").alias("at")).agg(F.min("modules").alias("modules"))
        ways = lists[2].lay(best.join(seen, ["repo_id", "start", "at"], "left_anti").select("repo_id", "start", "at", F.concat("modules", F.array("at")).alias("modules")))
        seen = lists[3].lay(seen.union(ways.select("repo_id", "start", "at")))
    first = F.array_position("modules", F.array_min("modules")).cast("int")
    turned = F.concat(F.slice("modules", first, F.size("modules")), F.slice("modules", F.lit(1), first - 1))
    return found.select("repo_id", turned.alias("modules")).distinct().withColumn("length", F.size("modules"))


def cycle_evidence(cycles: DataFrame, facts: DataFrame, order: str = "ord") -> DataFrame:
    """Imports that link neighbouring modules of a cycle, one per file pair.

    An import points into a module if a package of that module is a prefix of it;
    the module's first such file stands for the target.
    """
    n = F.size("modules")
    pairs = cycles.select(
        "repo_id", "modules",
        F.explode(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.get("modules", i).alias("module"), F.get("modules", (i + 1) % n).alias("to_module")),
        )).alias("p"),
    ).select("repo_id", F.array_join("modules", ">").alias("cycle"), "p.module", "p.to_module")
    links = pairs.select("repo_id", "module", "to_module").distinct()
    firsts = facts.where("package IS NOT NULL").groupBy("repo_id", F.col("module").alias("to_module"), "package").agg(
        F.min(F.struct(order, "path")).alias("first")
    )
    parts = F.split("import", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ".")
    )
    spread = usable_imports(facts).withColumn("package", F.explode(prefixes))
    hits = (
        spread.join(links, ["repo_id", "module"])
        .join(firsts, ["repo_id", "to_module", "package"])
        .groupBy("repo_id", "module", "to_module", "path", "import")
        .agg(F.min("first")["path"].alias("target"))
        .groupBy("repo_id", "module", "to_module", "path", "target")
        .agg(F.min("import").alias("import"))
    )
    return pairs.join(hits, ["repo_id", "module", "to_module"]).select(
        "repo_id", "cycle", "module", "to_module", F.col("path").alias("source"), "import", "target"
    )


def layer_violations(facts: DataFrame, order: str = "ord") -> DataFrame:
    hit = paths.is_controller(F.col("path")) & paths.is_data_access(F.col("target"))
    return resolved_imports(facts, order).where(hit).select(
        "repo_id", F.col("path").alias("source"), "module", "import", "target", "target_module"
    )


def file_roles(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", paths.role(F.col("path"), F.col("package")).alias("role"))


def affected_files(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files (direct) and unchanged files an edge leads to or from them (indirect)."""
    direct = changed.select("repo_id", "path").distinct()
    ends = edges.select("repo_id", F.col("source").alias("path"), F.col("target").alias("other"))
    both = ends.union(ends.select("repo_id", F.col("other"), F.col("path")))
    near = both.join(direct, ["repo_id", "path"], "left_semi").select("repo_id", F.col("other").alias("path")).distinct()
    indirect = near.join(direct, ["repo_id", "path"], "left_anti")
    return direct.withColumn("reach", F.lit("direct")).union(indirect.withColumn("reach", F.lit("indirect")))


def impact_scope(affected: DataFrame, cycles: DataFrame, violations: DataFrame) -> DataFrame:
    """Affected file counts and risk per repository: cycles high, layer violations medium, else low."""
    files = affected.groupBy("repo_id").agg(
        F.count(F.when(F.col("reach") == "direct", 1)).alias("direct_files"),
        F.count(F.when(F.col("reach") == "indirect", 1)).alias("indirect_files"),
    )
    c = cycles.groupBy("repo_id").agg(F.count(F.lit(1)).alias("cycles"))
    v = violations.groupBy("repo_id").agg(F.count(F.lit(1)).alias("violations"))
    out = files.join(c, "repo_id", "left").join(v, "repo_id", "left").fillna(0, ["cycles", "violations"])
    return out.withColumn("risk", F.when(F.col("cycles") > 0, "HIGH").when(F.col("violations") > 0, "MEDIUM").otherwise("LOW"))


def risk_signals(cycles: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per signal."""
    loop = cycles.select("repo_id", F.lit("cycle").alias("kind"), F.array_join("modules", " > ").alias("signal"))
    layer = violations.select("repo_id", F.lit("layer").alias("kind"), F.concat_ws(" > ", "source", "target").alias("signal"))
    return loop.union(layer).distinct()
