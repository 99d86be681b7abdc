"""Near-duplicate lines: segment partition, length-aware substring probes, bit-parallel check.

Two lines within ``edits`` edits, cut into edits + 1 segments, share one segment whole.  Lines
are made distinct by hash first; each then carries its own segments (index keys) and the
substrings where a shorter line's segments could stand (probe keys), all as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.graph import components
from gitstrata.llm.rows import without_repeated_rows
from gitstrata.llm.sized import settled, sized

EDITS = 1
LEAST_CHARS = 24  # shorter lines are repeats only when equal
STEP = 32  # an equal start is skipped in steps of so many characters
LETTERS = "eantriosl"  # counted per line; one edit moves two counts by one
FEW = 4  # of them are compared first

DOC = ["doc_id", "text_hash"]


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """(first place from 0, size) of segment i of a line: even parts, longer ones last."""
    parts = edits + 1
    size = F.floor(length / parts).cast("int")
    long = length - size * parts  # how many of the last segments have one more
    before = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - long))
    return size * i + before, size + F.when(F.lit(i) >= F.lit(parts) - long, 1).otherwise(0)


def key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    return [key(line, length, i, *segment(length, i, edits)) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Substrings that a segment of a line, as long or shorter, may equal after at most ``edits`` edits.

    Seen from the left a segment i has moved by at most i places, seen from the right by at
    most edits - i; places that are the line's own segments are index keys already.
    """
    keys = []
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, size = segment(other, i, edits)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            keys += [key(line, other, i, start + move, size) for move in range(low, high + 1) if less or move]
    return keys


def letter_counts(line: Column) -> Column:
    packed = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(127)).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(n, 7 * i))
    return packed


def count_gap(a: Column, b: Column, letters: int) -> Column:
    """Sum of the differences in the counts of the first ``letters`` letters."""
    gap = F.lit(0)
    for i in range(letters):
        one = F.shiftright(a, 7 * i).bitwiseAND(F.lit(127)) - F.shiftright(b, 7 * i).bitwiseAND(F.lit(127))
        gap = gap + F.abs(one)
    return gap


def within(p: Column, t: Column, edits: int, most: int | None = None) -> Column:
    """Whether two strings, at most ``edits`` apart in length, are within ``edits`` edits.

    With ``most`` only so many characters are compared: false is then certain, as costs never
    fall along a diagonal, and true is not.

    The band of 2 * edits + 1 diagonals is one small bit vector; a step over a character of
    ``t`` takes a few integer operations (vp/vn: vertical steps up/down, d0: diagonal without
    cost).  The distance is read along the diagonal that ends in the last cell.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    pad = F.array_repeat(F.lit(""), edits)
    rows = F.concat(pad, F.split(p if most is None else F.substring(p, 1, most + edits), ""), pad)
    cols = F.split(t if most is None else F.substring(t, 1, most), "")
    length = F.length(t) if most is None else F.least(F.length(t), F.lit(most))
    skew = F.length(p) - F.length(t)
    inv = lambda x: x.bitwiseXOR(F.lit(full))
    start = F.struct(
        F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.abs(skew).alias("far"),
    )

    def matches(x: Column) -> Column:
        bits = F.lit(0)
        for i in range(width):
            bits = bits + F.when(x[f"r{i}"] == x["c"], 1 << i).otherwise(0)
        return bits

    def advance(s: Column, x: Column) -> Column:
        vp, vn, eq = s["vp"], s["vn"], x["eq"]
        d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(inv(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        miss = F.when(x["j"] + 1 + skew < 1, 0).otherwise(1 - F.expr("1").bitwiseAND(F.call_function("shiftright", d0, skew + edits)))
        return F.when(s["far"] > edits, s).otherwise(F.struct(
            hn.bitwiseOR(inv(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
            (s["far"] + miss).alias("far"),
        ))

    # Every diagonal's characters are laid beside the columns once, not looked up in each step.
    beside = F.arrays_zip(F.slice(cols, 1, length).alias("c"), *[F.slice(rows, 1 + i, length).alias(f"r{i}") for i in range(width)])
    steps = F.transform(beside, lambda x, j: F.struct(j.alias("j"), matches(x).alias("eq")))
    return F.aggregate(steps, start, advance, lambda s: s["far"]) <= edits


def same_start(p: Column, t: Column) -> Column:
    """Characters at the start that are equal in both, in whole steps of ``STEP``."""
    steps = F.sequence(F.lit(0), F.floor(F.least(F.length(p), F.length(t)) / STEP).cast("int"))
    equal = F.transform(steps, lambda i: F.substring(p, i * STEP + 1, F.lit(STEP)) == F.substring(t, i * STEP + 1, F.lit(STEP)))
    differs = F.array_position(equal, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(equal) - 1).cast("int") * STEP


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line with visible text: document, place, hashes, and the line itself."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")
        .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    )


def distinct_lines(docs: DataFrame, edits: int) -> DataFrame:
    """One row per different line, with its first place, length, letter counts and keys."""
    line, n = F.col("line"), F.char_length("line")
    long = n >= LEAST_CHARS
    keys = [*index_keys(line, n, edits), *probe_keys(line, n, edits)]
    seen = occurrences(docs).select(
        "h1", "h2", F.struct("doc_id", "text_hash", "line_no").alias("place"),
        F.when(long, letter_counts(line)).alias("letters"),
        *[F.when(long, k).alias(f"k{i}") for i, k in enumerate(keys)],
    )
    return seen.groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.count("*").alias("times"),
        *[F.max(c).alias(c) for c in seen.columns[3:]],
    )


def candidate_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of different lines that share a segment and could be ``edits`` apart by their letters."""
    total = sum(c[0] == "k" for c in lines.columns)
    long = lines.where("letters is not null")
    rows = lambda first, stop: long.select(
        "h1", "letters", F.explode(F.array(*[F.col(f"k{i}") for i in range(first, stop)])).alias("k")
    )
    own = rows(0, edits + 1)
    probing = rows(edits + 1, total)
    a = own.select(F.col("h1").alias("a"), F.col("letters").alias("la"), "k")
    # A few letters rule most pairs out, so all of them are compared for the rest only.
    few = lambda n: count_gap(F.col("la"), F.col("lb"), n) <= 2 * edits
    pairs = None
    for other, order in ((own, F.col("a") < F.col("b")), (probing, F.col("a") != F.col("b"))):
        b = other.select(F.col("h1").alias("b"), F.col("letters").alias("lb"), F.col("k").alias("kb"))
        found = a.join(b, (a["k"] == b["kb"]) & order & few(FEW) & few(len(LETTERS))).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        )
        pairs = found if pairs is None else pairs.union(found)
    return pairs.distinct()


def line_texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, line) of the wanted lines, read at their first places."""
    places = sized(wanted.join(lines.select("h1", "place.*"), "h1"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    return texts.join(
        places, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))
    ).select("h1", F.get(F.split("text", "\n"), F.col("line_no")).alias("line")).dropDuplicates(["h1"])


def repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, text_hash, removed): line numbers that repeat an earlier line of any document.

    Lines within ``edits`` edits are linked, and of each connected class the first line stays,
    by doc_id, text and place.  Lines below ``LEAST_CHARS`` repeat only when equal; blank
    lines, null and empty texts have none.  Rows equal in doc_id and text count once.
    """
    lines = cut(distinct_lines(docs, edits))
    pairs = cut(candidate_pairs(lines, edits))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    texts = cut(line_texts(docs, lines, wanted))
    # Few and small rows, but much work on each: as many tasks as a shuffle has.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.join(texts.toDF("a", "p"), "a").join(texts.toDF("b", "t"), "b").repartition(tasks, "a", "b")
    close = F.abs(F.length("p") - F.length("t")) <= edits
    # What stands equal at the start changes no distance; most others differ soon after it.
    told = sides.where(close).withColumn("skip", same_start(F.col("p"), F.col("t")))
    rest = lambda c: F.substring(F.col(c), F.col("skip") + 1, F.length(c))
    told = told.select("a", "b", rest("p").alias("p"), rest("t").alias("t"))
    likely = told.where(within(F.col("p"), F.col("t"), edits, 2 * STEP))
    links = likely.where(within(F.col("p"), F.col("t"), edits)).select("a", "b")
    classes = components(links).select(F.col("node").alias("h1"), "component")
    classed = lines.select("h1", "h2", "place", "times").join(classes, "h1", "left")
    shared = classed.where("times > 1 or component is not null").withColumn("class", F.coalesce("component", "h1"))
    # A line known once and linked to nothing stands for itself; only the others meet again.
    first = shared.groupBy("class").agg(F.min("place").alias("first"))
    # Written here, so that what was shuffled to find it is gone before texts are.
    stays = settled(shared.select("h1", "h2", "class").join(first, "class").select("h1", "h2", "first"))
    found = occurrences(docs).select("doc_id", "text_hash", "line_no", "h1", "h2").join(stays, ["h1", "h2"])
    mine = F.struct("doc_id", "text_hash", "line_no")
    return found.where(~mine.eqNullSafe(F.col("first"))).groupBy(*DOC).agg(F.collect_set("line_no").alias("removed"))


def clean(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents without repeated lines, with n_lines and n_removed.

    A null text stays null and an empty one empty; a document all of whose lines are repeats
    has an empty text.  Of rows equal in doc_id and text one is left.  Other columns are
    carried unchanged.
    """
    docs = without_repeated_rows(docs)
    gone = repeats(docs, edits).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    joined = rows.join(gone, same, "left").select("row", "text", F.split("text", "\n").alias("lines"), "removed")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text")
    visible = F.size(F.filter("lines", lambda x: F.trim(x) != ""))
    return joined.select(
        *[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(visible).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )
