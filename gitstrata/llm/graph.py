"""Connected components of a table of links, without a pass per path step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    Alternating large-star and small-star steps: a node hands its larger (then smaller)
    neighbours to its smallest one, so a path of length n shrinks in about log n rounds
    and the table never outgrows the links.  Minima are pre-aggregated before the
    shuffle, and joins leave hot nodes to the adaptive planner's splitting.  Self links
    and nulls are ignored; no links give no rows.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
        F.sum(F.col("v").cast("decimal(20,0)")).alias("t"),
    ).first()
    return row["n"], row["s"], row["t"]
