"""Awkward rows every operator must stand: nulls, empty, long, repeated and clashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "stone river cloud amber violet harbor meadow copper lantern willow".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % 10] + WORDS[x // 7 % 10])
    return " ".join(out)


def frame(spark: SparkSession, texts: list, first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    """Null text, id and label; empty and blank texts; a long text; a repeated row; clashing columns."""
    long = prose(3, 60_000)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, prose(1, 80), "en"), (4, prose(1, 80), "en"),
        (5, prose(1, 80), "fr"), (None, prose(2, 40), "en"), (6, long, "en"), (7, "x" * 50_000, "fr"), (8, "1234 !!", "en"),
    ]
    names = ["row", "part", "key", "h", "hash", "text_hash", "class_id", "removed", "lines", "start", "n", "shard", "length"]
    df = spark.createDataFrame(
        [(*r, "s", None, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names)
    )
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
