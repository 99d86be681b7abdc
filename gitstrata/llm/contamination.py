"""Benchmark passages in documents: SimHash of item-sized windows, block index, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.sized import sized

WORDS = 5  # words of a shingle; an item with fewer words is one shingle
SIMILARITY = 0.8
RADIUS = 15  # bits two fingerprints may differ in; RADIUS + 1 blocks of 4 bits index them
ITEM_SHINGLES = 1_000_000  # shingles of the benchmark that are broadcast at most

DOC = ["doc_id", "text_hash"]


def words_of(text: str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, n: int) -> Column:
    """Hash of every run of n words, in order; none in a shorter text."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def fingerprint(words: Column) -> Column:
    """64-bit SimHash: bit b is set where more words have it in their hash than not."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1))
    votes = F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + bit(h, b) * 2 - 1)
    )
    return F.aggregate(
        F.transform(votes, lambda v, b: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )


def blocks(print_: str) -> Column:
    """The fingerprint in RADIUS + 1 blocks: two within the radius share one."""
    size = 64 // (RADIUS + 1)
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, size * i).bitwiseAND(F.lit((1 << size) - 1)).alias("value"))
        for i in range(RADIUS + 1)
    ])


def items_of(benchmark: DataFrame) -> DataFrame:
    """Different items with words: smallest item_id, copies, words, size and shingle length."""
    return (
        benchmark.select("item_id", words_of("text").alias("words")).where("size(words) > 0")
        .groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
        .withColumn("item", F.xxhash64("words"))
        .withColumn("size", F.size("words"))
        .withColumn("n", F.least(F.lit(WORDS), F.col("size")))
    )


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Item-sized windows (doc, size, start, words) that hold a shingle of an item of that size.

    A window without one has similarity 0, so none that counts is left out.  A document with
    fewer words than the item is one window at 0: all its words, ``size`` still the item's.
    """
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hits = None
    for n in [r["n"] for r in items.select("n").distinct().collect()]:  # 1 to WORDS
        known = items.where(F.col("n") == n).select(
            "size", F.posexplode(shingles(F.col("words"), n)).alias("at", "shingle")
        ).distinct()
        seen = text.select(*DOC, words_of("text").alias("words")).select(
            *DOC, F.size("words").alias("length"), F.posexplode(shingles(F.col("words"), n)).alias("pos", "shingle")
        )
        found = seen.join(sized(known, ITEM_SHINGLES), "shingle").select(
            *DOC, "size", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("length") - F.col("size"))).alias("start")
        )
        hits = found if hits is None else hits.union(found)
    hits = cut(hits.distinct())
    places = sized(hits.groupBy(*DOC).agg(F.collect_set(F.struct("size", "start")).alias("wanted")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "wanted"
    ))
    return (
        text.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
        .dropDuplicates(DOC)
        .select(*DOC, words_of("text").alias("words"), "wanted")
        .select(*DOC, "words", F.explode("wanted").alias("w"))
        .select(*DOC, "w.*", F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("words"))
    )


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, copies, start, n_words, similarity: passages found, best window each.

    Null, empty and wordless texts or items match nothing; equal items are one, with the
    smallest id and their number; rows equal in doc_id and text are one document.  Words are
    runs of letters and digits in lower case, so punctuation and case don't hide a passage.
    """
    items = cut(items_of(benchmark)) if not benchmark.isEmpty() else items_of(benchmark)
    if items.isEmpty():
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash")).where("false").select(
            *DOC, *[F.lit(None).cast(t).alias(c) for c, t in (
                ("item_id", benchmark.schema["item_id"].dataType.simpleString()), ("copies", "long"),
                ("start", "int"), ("n_words", "int"), ("similarity", "double"))]
        )
    marked = items.withColumn("print", fingerprint(F.col("words")))
    seen = cut(windows(docs, items).withColumn("print", fingerprint(F.col("words"))))
    left = seen.select(*DOC, "size", "start", F.col("print").alias("p"), F.explode(blocks("print")).alias("b")).select(
        *DOC, "size", "start", "p", "b.*"
    )
    right = marked.select("item", "size", F.col("print").alias("q"), F.explode(blocks("print")).alias("b")).select(
        "item", "size", "q", "b.*"
    )
    close = left.join(
        right, (left["size"] == right["size"]) & (left["block"] == right["block"]) & (left["value"] == right["value"])
        & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= RADIUS),
    ).select(*DOC, left["size"], "start", "item").distinct()
    pairs = cut(close)
    n = F.least(F.lit(WORDS), F.size("words"))
    of_window = pairs.join(
        seen.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("size").alias("s"), F.col("start").alias("f"), "words"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("size") == F.col("s")) & (F.col("start") == F.col("f")),
    ).select(*pairs.columns, F.lit(1).alias("mine"), "words")
    of_item = pairs.join(items.select("item", "words"), "item").select(*pairs.columns, F.lit(0).alias("mine"), "words")
    counted = (
        of_window.union(of_item)
        .withColumn("shingle", F.explode(_shingles_up_to(n)))
        .groupBy(*pairs.columns, "shingle").agg(F.sum("mine").alias("here"), F.sum(1 - F.col("mine")).alias("there"))
        .groupBy(*pairs.columns).agg(
            (F.sum(F.least("here", "there")) / F.sum(F.greatest("here", "there"))).alias("similarity"), F.sum("here").alias("here")
        )
        .where(F.col("similarity") >= similarity)
    )
    best = counted.groupBy(*DOC, "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", "here")).alias("m")
    )
    return best.join(items.select("item", "item_id", "copies"), "item").select(
        *DOC, "item_id", "copies", (-F.col("m.back")).alias("start"), (F.col("m.here") + F.least(F.lit(WORDS), F.col("m.size")) - 1).cast("int").alias("n_words"),
        F.col("m.similarity").alias("similarity"),
    )


def _shingles_up_to(n: Column) -> Column:
    found = shingles(F.col("words"), WORDS)
    for k in range(WORDS - 1, 0, -1):
        found = F.when(n == k, shingles(F.col("words"), k)).otherwise(found)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no benchmark passage was found, all columns unchanged."""
    hit = sized(find(docs, benchmark, similarity).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash"))
    return rows.join(hit, same, "left_anti").select("row.*")
