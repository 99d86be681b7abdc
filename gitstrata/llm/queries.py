"""Registered queries of the operators, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.llm import (
    centroids, contamination, embeddings, fingerprints, jaccard, langid, lines, negatives, packing, passages, pii, secrets, sharding,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


@query
def op6_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("anchor"))
    return negatives.mine(rows)


ORACLES["op11_hard_negatives"] = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
),
cells AS MATERIALIZED (SELECT vec_id, label, unnest(range(len(q))) AS i, unnest(q) AS x FROM usable),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM cells a JOIN cells b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY ALL
),
positives AS MATERIALIZED (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""


@query
def op12_pca_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _assigned(n: int) -> str:
    """SQL: every vector's nearest centroid of round ``n``."""
    return f"""
far{n} AS MATERIALIZED (
  SELECT e.vec_id, c.k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM cells e JOIN centroid{n} c ON c.i = e.i GROUP BY ALL
),
near{n} AS MATERIALIZED (
  SELECT vec_id, k, d FROM far{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1
)"""


def _moved(n: int) -> str:
    """SQL: centroids after round ``n``; // goes towards zero, so the remainder is made positive first."""
    return f"""
centroid{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN count(e.x) = 0 THEN c.x
    ELSE CAST((sum(e.x) - ((sum(e.x) % count(e.x)) + count(e.x)) % count(e.x)) // count(e.x) AS BIGINT) END AS x
  FROM centroid{n} c LEFT JOIN near{n} a ON a.k = c.k LEFT JOIN cells e ON e.vec_id = a.vec_id AND e.i = c.i
  GROUP BY c.k, c.i, c.x
)"""


ORACLES["op12_pca_clusters"] = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
),
cells AS MATERIALIZED (SELECT vec_id, unnest(range(len(q))) AS i, unnest(q) AS x FROM kept),
starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM kept QUALIFY k < 16
),
centroid0 AS MATERIALIZED (SELECT s.k, e.i, e.x FROM starts s JOIN cells e USING (vec_id)),
""" + ",".join(_assigned(n) + "," + _moved(n) for n in range(3)) + "," + _assigned(3) + """,
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS name FROM centroid3 GROUP BY k)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, n.name AS centroid_sha256
FROM near3 a JOIN named n USING (k)
"""


@query
def op13_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
