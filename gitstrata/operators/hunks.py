"""Hunks of unified diffs, worked out inside each diff's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CONTEXT = 5
_GAP = r"[^\S\n]+"
_HEADER = rf"@@{_GAP}-(\d+)(?:,(\d+))?{_GAP}\+(\d+)(?:,(\d+))?{_GAP}@@"
_CUT = rf"(?<![^\n])(?={_HEADER})"


def path_in_header(diff: Column) -> Column:
    found = F.regexp_extract(diff, r"(?m)^diff --git a/(.+) b/(.+)$", 2)
    return F.when(found != "", found)


def within_size(diffs: DataFrame, limit: int) -> DataFrame:
    """Diffs of at most ``limit`` characters, for readers that can't take more."""
    return diffs.where(F.length("unified_diff") <= limit)


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk.  An omitted count is 1; empty and binary diffs give none."""
    diff = F.col("unified_diff")
    usable = diffs.where((diff != "") & ~diff.rlike(r"(?i)^Binary files .+ and .+ differ"))
    pieces = F.filter(F.split(diff, _CUT), lambda p: p.rlike("^" + _HEADER))
    rest = [F.col(c) for c in diffs.columns if c not in ("unified_diff", "path")]
    rows = usable.select(
        *rest, F.coalesce("path", path_in_header(diff)).alias("path"), F.posexplode(pieces).alias("hunk_no", "_raw")
    )
    number = lambda i: F.regexp_extract("_raw", "^" + _HEADER, i)
    count = lambda i: F.when(number(i) == "", 1).otherwise(number(i).cast("int"))
    return rows.select(
        *rest, "path", "hunk_no",
        number(1).cast("int").alias("old_start"), count(2).alias("old_count"),
        number(3).cast("int").alias("new_start"), count(4).alias("new_count"),
        F.regexp_replace("_raw", r"\n+$", "").alias("raw"),
    )


def bodies(hunks: DataFrame) -> DataFrame:
    """Context before (last 5 lines), changed lines, context after (first 5 lines)."""
    lines = F.filter(F.split("raw", "\n"), lambda x: ~x.startswith("@@"))
    changed = lambda x: x.startswith("+") | x.startswith("-")
    plain = lambda x: F.when(x.startswith(" "), F.substring(x, 2, 1 << 30)).otherwise(x)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = hunks.withColumn("_l", lines).withColumn("_f", F.array_position(F.transform("_l", changed), True).cast("int"))
    before = F.slice("_l", F.greatest(F.col("_f") - CONTEXT, F.lit(1)), F.least(F.col("_f") - 1, F.lit(CONTEXT)))
    tail = F.slice("_l", F.col("_f") + 1, F.size("_l"))
    after = F.slice(F.filter(tail, lambda x: ~changed(x)), 1, CONTEXT)
    has = F.col("_f") > 0
    text = lambda arr: F.when(has, trim(F.array_join(arr, "\n"))).otherwise("")
    return (
        rows.withColumn("context_before", text(F.transform(before, plain)))
        .withColumn("change_text", trim(F.array_join(F.filter("_l", changed), "\n")))
        .withColumn("context_after", text(F.transform(after, plain)))
        .drop("_l", "_f")
    )


def old_ranges(hunks: DataFrame) -> DataFrame:
    """First and last old line of every hunk that has old lines."""
    kept = hunks.where("old_count > 0")
    return kept.withColumn("first", F.col("old_start")).withColumn("last", F.col("old_start") + F.col("old_count") - 1)


def aligned(first: Column, last: Column) -> Column:
    """The range as at most two aligned nodes a level: (level, node) stands for 2**level lines from node * 2**level.

    A range of any length gives less than two nodes per doubling of it, so a header that claims
    two thousand million lines costs a few dozen rows.  No node of a range is longer than it.
    """
    low, end = first.cast("long"), last.cast("long") + 1
    left = lambda k: F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    right = lambda k: F.call_function("shiftright", end, k)
    node = lambda on, k, n: F.when(on, F.struct(k.alias("level"), n.alias("node")))
    of = lambda k: F.array(
        node((left(k) < right(k)) & (left(k) % 2 == 1), k, left(k)), node((left(k) < right(k)) & (right(k) % 2 == 1), k, right(k) - 1)
    )
    top = F.least(F.floor(F.log2(F.greatest(end - low, F.lit(1)))).cast("int") + 1, F.lit(32))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), of)))


def in_ranges(lines: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``lines`` (keys, line_no, ...) with every row of ``ranges`` (keys, first, last, ...) that holds their line.

    An interval join by equality: a range is put under its aligned nodes, a line under those
    nodes above it whose level some range of the same keys uses.
    """
    nodes = ranges.where((F.col("first") >= 0) & (F.col("first") <= F.col("last"))).withColumn("_n", F.explode(aligned(F.col("first"), F.col("last"))))
    nodes = nodes.select(*ranges.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    levels = nodes.select(*keys, "_level").distinct()
    placed = lines.join(levels, keys).withColumn("_node", F.expr("shiftright(cast(line_no AS bigint), _level)"))
    return placed.join(nodes, [*keys, "_level", "_node"]).drop("_level", "_node")


def old_lines(hunks: DataFrame) -> DataFrame:
    return old_ranges(hunks).withColumn("line_no", F.explode(F.sequence("first", "last")))


def kind() -> Column:
    old, new = F.col("old_count"), F.col("new_count")
    return F.when((old == 0) & (new > 0), "ADD").when((old > 0) & (new == 0), "DELETE").otherwise("MODIFY")


def with_kind(hunks: DataFrame) -> DataFrame:
    return hunks.withColumn("kind", kind())
