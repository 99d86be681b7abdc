"""Preparing changed files for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import paths, text
from gitstrata.functions.scale import attach, cut, jump_tables, mark_ahead, running
from gitstrata.operators import structure as G

# Size of a chunk in characters and of a small module in files.
CHUNK_CHARS = 30_000
SMALL_GROUP = 3
SMALL = "small-modules"


def reviewable(diffs: DataFrame) -> DataFrame:
    """Drop deleted files, binaries, documents, configuration and deployment folders."""
    deleted = F.lower(F.coalesce("change_type", F.lit(""))).isin("delete", "deleted")
    return diffs.where(~deleted & (F.col("path").isNull() | paths.is_code(F.col("path"))))


def review_groups(files: DataFrame, small: int = SMALL_GROUP) -> DataFrame:
    """Group files by module; modules with fewer than ``small`` files share one group."""
    rows = files.withColumn("module", paths.module_of(F.col("path")))
    sizes = rows.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("_n"))
    return attach(rows, sizes, ["repo_id", "module"]).withColumn(
        "review_group", F.when(F.col("_n") < small, SMALL).otherwise(F.col("module"))
    ).drop("_n")


def cross_module_context(groups: DataFrame, facts: DataFrame, diffs: DataFrame, most: int | None = None) -> DataFrame:
    """Per group: changed types it imports from files outside the group, with their diff or its first ``most`` characters.

    ``groups`` (repo_id, path, review_group); ``diffs`` one unified diff per file.
    """
    g = groups.select("repo_id", "path", "review_group")
    # Import prefixes skipped here.
    imports = G.usable_imports(facts, ["java.", "javax.", "sun."]).join(g, ["repo_id", "path"])
    index = G.class_index(facts).withColumnRenamed("fqcn", "import")
    homes = g.select("repo_id", F.col("path").alias("target"), F.col("review_group").alias("_home"))
    wanted = (
        imports.select("repo_id", "review_group", "import").distinct()
        .join(index.select("repo_id", "import", "target"), ["repo_id", "import"])
        .join(homes, ["repo_id", "target"])
        .where(F.col("_home") != F.col("review_group"))
    )
    d = diffs.select("repo_id", F.col("path").alias("target"), (F.col("unified_diff") if most is None else text.shorten(F.col("unified_diff"), most, "\n... [diff truncated]")).alias("diff"))
    return wanted.join(d, ["repo_id", "target"], "left").select("repo_id", "review_group", "import", "target", "diff")


def capped(column: Column, limit: int | None) -> Column:
    """A text cut to ``limit`` with the full length noted; whole without one."""
    if limit is None:
        return column
    note = F.concat(F.lit("\n... [truncated, total "), F.length(column), F.lit(" chars]"))
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, limit), note)).otherwise(column)


def size_caps(files: DataFrame, *, diff: int | None = None, content: int | None = None, edge: int | None = None) -> DataFrame:
    """Diff and content for review input, each cut to the characters its reader takes; whole by default."""
    note = "\n... [truncated]"
    return files.select(
        "repo_id", "path",
        capped(F.col("unified_diff"), diff).alias("diff_part"),
        (F.col("content") if content is None else text.shorten(F.col("content"), content, note)).alias("content_part"),
        capped(F.col("content"), edge).alias("edge_part"),
    )


def chunks(files: DataFrame, keys: list[str], limit: int = CHUNK_CHARS, cap: int | None = None) -> DataFrame:
    """Greedy chunks in ``ord`` order: a new one starts when the running size would pass ``limit``.

    Each file knows from running sums where a chunk that starts at it would end,
    which makes a graph with one successor per file; following it from the first
    file gives the chunk starts.  No module is walked through in one task.
    """
    size = F.length(F.coalesce("content", F.lit(""))).cast("long")
    size = size if cap is None else F.least(size, F.lit(cap))
    size = F.least(size, F.lit(limit))  # a larger file fills a chunk of its own
    rows = files.withColumn("_size", size)
    rows = cut(running(rows, keys, [F.col("ord")], {"_sum": ("sum", F.col("_size")), "_i": ("sum", F.lit(1))}))
    probes = rows.select(*keys, F.col("_i").alias("i"), (F.col("_sum") - F.col("_size") + limit).alias("at"), F.lit(0).alias("mark"))
    marks = rows.select(*keys, F.col("_i").alias("i"), F.col("_sum").alias("at"), F.lit(1).alias("mark"))
    order = [F.col("at").desc(), F.col("mark"), F.col("i").desc()]
    linked = running(probes.union(marks), keys, order, {"nxt": ("last", F.when(F.col("mark") == 1, F.col("i")))})
    jumps = jump_tables(linked.where("mark = 0"), keys, "i", "nxt")
    first = rows.select(*keys).distinct().withColumn("i", F.lit(1).cast("long"))
    starts = mark_ahead(jumps, first, keys, "i", "nxt").withColumnRenamed("i", "_i").withColumn("_start", F.lit(1))
    flagged = rows.join(starts, [*keys, "_i"], "left")
    out = running(flagged, keys, [F.col("ord")], {"chunk": ("sum", F.coalesce("_start", F.lit(0)))})
    return out.select(*files.columns, "chunk")


def signature_lines(facts: DataFrame) -> DataFrame:
    """``path: types → methods`` of every file that declares a type."""
    methods = F.when(F.size("methods") > 0, F.concat(F.lit(" → "), F.array_join("methods", ", "))).otherwise("")
    return facts.where(F.size("types") > 0).select(
        "repo_id", "path", F.concat(F.col("path"), F.lit(": "), F.array_join("types", ", "), methods).alias("signature")
    )


def chunk_signatures(chunked: DataFrame, facts: DataFrame) -> DataFrame:
    """Signature of every file with its chunk; one row per file, whatever the number of chunks."""
    return chunked.drop("content").join(signature_lines(facts), ["repo_id", "path"])


def signatures_outside(chunked: DataFrame, facts: DataFrame, chunk: int) -> DataFrame:
    """Signatures of the files outside one chunk of their group."""
    return chunk_signatures(chunked, facts).where(F.col("chunk") != chunk)


# Modifiers that open a method, and annotations worth keeping.
MODIFIERS = "public|private|protected|static|synchronized|final|abstract|native"
KEY_ANNOTATIONS = "Transactional|Async|Override|Cacheable|DS|Scheduled|Validated"


def method_signatures(sources: DataFrame) -> DataFrame:
    """Method signatures of a file in order, joined over lines, with a kept annotation in front.

    One fold over the lines of each row.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.transform(F.split("content", "\n"), trim)
    opens = rf"^({MODIFIERS}).*\(.*\)(.*\{{.*|\s*$|\s*throws.*)"
    none = F.lit(None).cast("string")

    def finish(sigs: Column, note: Column, sig: Column) -> Column:
        head = F.when(F.locate("{", sig) > 1, trim(F.substring_index(sig, "{", 1))).otherwise(sig)
        head = trim(F.regexp_replace(head, r";$", ""))
        return F.concat(sigs, F.array(F.when(note.isNull(), head).otherwise(F.concat(note, F.lit(" "), head))))

    def step(acc: Column, line: Column) -> Column:
        sigs, note, sig = acc["sigs"], acc["note"], acc["sig"]
        ends = sig.isNotNull() & ((line == "") | line.startswith("@") | line.startswith("//"))
        grows = sig.isNotNull() & ~ends
        longer = F.concat(sig, F.lit(" "), line)
        grown_done = longer.rlike("[{;]")
        sigs0 = F.when(ends, finish(sigs, note, sig)).otherwise(sigs)
        note0 = F.when(ends, none).otherwise(note)
        starts = line.rlike(opens)
        done = line.rlike("[{;]")
        kept = line.startswith("@") & line.rlike(KEY_ANNOTATIONS)
        state = lambda a, b, c: F.struct(a.alias("sigs"), b.alias("note"), c.alias("sig"))
        fresh = (
            F.when(line == "", state(sigs0, note0, none))
            .when(kept, state(sigs0, line, none))
            .when(starts & done, state(finish(sigs0, note0, line), none, none))
            .when(starts, state(sigs0, note0, line))
            .otherwise(state(sigs0, none, none))
        )
        growing = F.when(grown_done, state(finish(sigs, note, longer), none, none)).otherwise(state(sigs, note, longer))
        return F.when(grows, growing).otherwise(fresh)

    zero = F.struct(F.array().cast("array<string>").alias("sigs"), none.alias("note"), none.alias("sig"))
    folded = F.aggregate(lines, zero, step, lambda a: F.when(a["sig"].isNull(), a["sigs"]).otherwise(finish(a["sigs"], a["note"], a["sig"])))
    return sources.select("repo_id", "path", F.posexplode(folded).alias("pos", "signature"))


def source_lines(sources: DataFrame) -> DataFrame:
    """One numbered row per line, with its display form and the file's line count."""
    rows = sources.where(F.coalesce("content", F.lit("")) != "").select(
        *[c for c in sources.columns if c != "content"], F.split("content", "\n").alias("_l")
    )
    rows = rows.withColumn("line_count", F.size("_l"))
    out = rows.select(*[c for c in rows.columns if c != "_l"], F.posexplode("_l").alias("_p", "line"))
    padded = F.expr("lpad(cast(_p + 1 as string), greatest(length(cast(line_count as string)), 4), ' ')")
    number = (F.col("_p") + 1).cast("int")
    return out.withColumn("line_no", number).withColumn("shown", F.concat(padded, F.lit(" | "), F.col("line"))).drop("_p")
