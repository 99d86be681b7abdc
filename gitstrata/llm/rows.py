"""Rows that say the same twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.sized import sized


def without_repeated_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those equal in doc_id and text; rows with a null in either stay.

    What repeats is found on ids and hashes alone; texts are shuffled for repeated rows only.
    """
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    told = keyed.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "_text_hash")
    twice = sized(told.groupBy("doc_id", "_text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return docs
    key = ["doc_id", "_text_hash"]
    once = keyed.join(twice, key, "left_semi").dropDuplicates(key)
    return keyed.join(twice, key, "left_anti").unionByName(once).select(*docs.columns)
