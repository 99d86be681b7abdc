"""Secrets: strong patterns, and weak parts that count only near their complements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm import spans

# The base patterns.
BASE = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
LEAST_VALUE = 12

# Weak parts of a credential: none is reported alone.  Runs are possessive and unbounded, so that
# a match is whole and linear; a key may follow "=" and must mix its characters (MIXED).
WEAK = {
    "id_part": r"(?i)(?<![A-Za-z0-9])(?:access[_-]?key[_-]?id|account|client[_-]?id|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?"
               r"[A-Za-z0-9._@-]{3,}+",
    "key_part": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-])",
    "short_part": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|pass)[\"']?\x20*[:=]\x20*[\"']?[^\s\"']{4,}+",
    "endpoint_part": r"(?i)(?<![A-Za-z0-9])(?:https?|ftp|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}+",
}
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ROLE = {
    "assign": "secret", "hex": "secret", "access": "id",
    "id_part": "id", "key_part": "secret", "short_part": "secret", "endpoint_part": "endpoint",
}
SCOPE = 400  # characters between parts of one credential


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (row, kind, start, stop) with a complement within ``scope`` in the same document.

    A secret needs an identifier or endpoint, and these need a secret.  An interval join on
    blocks of ``scope`` characters: per document, block and role one row with the first start
    and last end.  Parts that both miss a candidate's scope on different sides lie more than
    a block apart, so those two ends decide exactly, and no pairs are made.
    """
    at = lambda c: F.floor(c / scope)
    blocks = (
        parts.withColumn("block", F.explode(F.sequence(at(F.col("start")), at(F.col("stop")))))
        .withColumn("side", F.when(F.col("role") == "secret", "secret").otherwise("place"))
        .groupBy("row", "block", "side").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    )
    weak = (
        parts.where("weak")
        .withColumn("block", F.explode(F.sequence(at(F.col("start") - scope), at(F.col("stop") + scope))))
        .withColumn("side", F.when(F.col("role") == "secret", "place").otherwise("secret"))
    )
    return (
        weak.join(blocks, ["row", "block", "side"])
        .where((F.col("first") <= F.col("stop") + scope) & (F.col("last") >= F.col("start") - scope))
        .select("row", "kind", "rank", "start", "stop").distinct()
    )


def detect(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts per base kind, checksum of the base spans, all spans, and their number.

    A null or empty text has no spans; repeated and null ids are documents of their own.
    A weak part inside a base span is not reported again.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = spans.find(text, "text", BASE | WEAK, {"access": "AKIA", "endpoint_part": "://"}).withColumn(
        "assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= LEAST_VALUE)
    ).withColumn(
        "key_part", F.filter("key_part", lambda x: x["hit"].rlike(MIXED[0]) & x["hit"].rlike(MIXED[1]) & x["hit"].rlike(MIXED[2]))
    )
    base = spans.ordered([(k, F.col(k)) for k in BASE])
    kept = cut(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        base.alias("base"), spans.ordered([(k, F.col(k)) for k in WEAK]).alias("wide"),
    ))
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    strong = kept.select("row", F.lit(False).alias("weak"), F.explode("base").alias("p"))
    weak = kept.where("size(wide) > 0").select(
        "row", F.lit(True).alias("weak"),
        F.explode(F.filter("wide", lambda w: ~F.exists(
            "base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])
        ))).alias("p"),
    )
    parts = strong.union(weak).select("row", "weak", "p.*").withColumn("role", F.element_at(role, F.col("kind")))
    added = linked(parts, scope).groupBy("row").agg(F.array_sort(F.collect_set(F.struct(
        "start", (F.col("rank") + len(BASE)).alias("rank"), "stop", "kind"
    ))).alias("added"))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return kept.join(added, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in BASE],
        F.sha2(spans.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans.written(every).alias("spans"), F.size(every).cast("long").alias("n_spans"),
    )
