"""Helpers for keys that may hold a large part of all rows.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task.  The
helpers here cut each key into range-partitioned chunks, work inside the chunks
and carry one summary row per (key, chunk) from chunk to chunk, so no task ever
sees more than one chunk.  A key has at most as many chunks as there are shuffle
partitions, which bounds the windows over the summaries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop, each written to the shared folder and read again as the next round's input.

    A checkpoint keeps the planner's size estimate; a join with itself multiplies it, so after
    some twenty rounds the estimate alone has a million digits.  A written table is measured
    anew.  Two folders take turns: a table lives until the one after the next is laid.
    """

    def __init__(self, spark: SparkSession) -> None:
        shared_dir(spark)
        self.spark, self.n = spark, 0
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"

    def lay(self, df: DataFrame) -> DataFrame:
        self.n += 1
        place = f"{self.folder}/{self.n % 2}"
        df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)


def _chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (keys, order), sort, and freeze chunk and position.

    The checkpoint is what makes the chunk number usable twice: range bounds are
    sampled, so a second evaluation could draw them elsewhere.
    """
    by = [F.col(k) for k in keys] + list(order)
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_pos", 33))
    )
    return cut(placed)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact ``row_number`` per key without gathering a key in one task.

    ``order`` must be total inside a key (end it with a unique column).
    """
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})


# Rows of one key that a task sorts without trouble, and the hash bins in which keys are counted.
TASK_ROWS, BINS = 1_000_000, 1 << 20

FOLD = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}
JOIN = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def widest(df: DataFrame, keys: Sequence[str]) -> int:
    """At least as many rows as any key has: rows are counted by a hash of the key, so counts stay small."""
    by = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BINS)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    return by.agg(F.max("_n")).first()[0] or 0


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    outs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    most: int = TASK_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Running aggregates per key over all earlier rows, chunk by chunk where a key may have more than ``most`` rows.

    Where none has, each key fits a task and a plain window needs no table in between.  ``width``
    is ``widest`` of the same keys, if known.

    ``outs`` maps an output column to (``sum`` | ``max`` | ``min`` | ``last``, input).
    ``last`` keeps the latest non-null input.  With ``inclusive=False`` the current
    row is left out.

    Rows are sorted across chunks, so only the first key of a chunk can have rows in
    earlier chunks: the carried values are at most one row per chunk, which is the
    size bound behind the broadcast.
    """
    if (widest(df, keys) if width is None else width) <= most:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select(*df.columns, *[FOLD[kind](expr).over(whole).alias(out) for out, (kind, expr) in outs.items()])
    rows = df
    for out, (_, expr) in outs.items():
        rows = rows.withColumn(f"_in_{out}", expr)
    rows = _chunks(rows, keys, order)

    aggs = []
    for out, (kind, _) in outs.items():
        src = F.col(f"_in_{out}")
        agg = F.max_by(src, F.when(src.isNotNull(), F.col("_pos"))) if kind == "last" else FOLD[kind](src)
        aggs.append(agg.alias(f"_sum_{out}"))
    per = rows.groupBy(*keys, "_chunk").agg(*aggs)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col("_chunk").alias("_r__chunk"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_nth"),
        *[FOLD[kind](F.col(f"_sum_{out}")).over(earlier).alias(f"_car_{out}") for out, (kind, _) in outs.items()],
    ).where("_nth > 1")

    inner = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = rows
    for out, (kind, _) in outs.items():
        local = local.withColumn(f"_loc_{out}", FOLD[kind](F.col(f"_in_{out}")).over(inner))
    same = local["_chunk"] == carried["_r__chunk"]
    for k in keys:
        same = same & local[k].eqNullSafe(carried[f"_r_{k}"])
    return local.join(F.broadcast(carried), same, "left").select(
        *df.columns,
        *[JOIN[kind](F.col(f"_car_{out}"), F.col(f"_loc_{out}")).alias(out) for out, (kind, _) in outs.items()],
    )


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], *, how: str = "left", salts: int = 32) -> DataFrame:
    """Join one-row-per-key facts onto many rows; a hot key is spread over ``salts``.

    Below the broadcast threshold the adaptive planner turns this into a broadcast
    by measured size; above it, no single task receives a whole key.  ``salts``
    copies every row of ``small``: keep it for keys that are few (repository,
    severity, module) and pass 1 where they are many (files), which leaves the
    splitting of hot partitions to the adaptive planner.
    """
    value_cols = [c for c in small.columns if c not in keys]
    if salts == 1:
        return big.join(small, list(keys), how).select(*big.columns, *value_cols)
    spread = F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys] or keys), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", spread)
    right = small.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *value_cols,
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_r__salt"),
    )
    cond = left["_salt"] == right["_r__salt"]
    for k in keys:
        cond = cond & (left[k] == right[f"_r_{k}"])
    return left.join(right, cond, how).select(*big.columns, *value_cols)


def jump_tables(nodes: DataFrame, keys: Sequence[str], node: str, nxt: str) -> list[DataFrame]:
    """Jumps of 1, 2, 4, ... steps along a graph with at most one successor per node."""
    cols = [*keys, node]
    levels = [cut(nodes.select(*cols, nxt).where(F.col(nxt).isNotNull()))]
    while True:
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        cond = F.col(f"a.{nxt}") == F.col(f"b.{node}")
        for k in keys:
            cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        far = cut(a.join(b, cond).select(*[F.col(f"a.{c}").alias(c) for c in cols], F.col(f"b.{nxt}").alias(nxt)))
        if far.isEmpty():
            return levels
        levels.append(far)


def mark_ahead(jumps: list[DataFrame], starts: DataFrame, keys: Sequence[str], node: str, nxt: str) -> DataFrame:
    """Every node met when following the graph from ``starts``, starts included.

    Going from the longest jump to the shortest reaches every distance once.
    """
    rest = starts.columns
    marked = starts.distinct()
    for i, level in enumerate(reversed(jumps)):
        there = level.withColumnRenamed(nxt, "_ahead")
        ahead = marked.join(there, [*keys, node]).withColumn(node, F.col("_ahead")).select(*rest)
        marked = marked.union(ahead).distinct()
        if i % 2 == 1:
            marked = cut(marked)
    return cut(marked)
