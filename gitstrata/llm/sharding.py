"""Jump consistent hashing: stable keys to shards, without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.carry import as_text, restored, whole_numbers

MULTIPLIER = np.uint64(2862933555777941757)  # fixed value of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; with one more shard, keys move only into the new one."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    nxt = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = nxt[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def assign(df: DataFrame, key: list[str], shards: int, carry: list[str]) -> DataFrame:
    """``carry`` columns, shard, slot (gapless from 0 in its shard) and grown_shard.

    Only the key's values and the shard count decide, so repeated keys meet in one shard
    and a null key is one key like any other.  Nothing is shuffled by shard: each task
    numbers its own rows per shard, and one offset per (task, shard) is added after.
    An empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(carry))]
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
        F.xxhash64(*key).alias("hashed"),
        F.spark_partition_id().alias("part"),
    )
    numbers = whole_numbers(rows, names)
    rows = as_text(rows, names)
    kept = [*names, "part"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch["hashed"].to_numpy(dtype=np.int64).view(np.uint64)
            shard = jump(keys, shards)
            local = pd.Series(shard).groupby(shard).cumcount().to_numpy() + seen[shard]
            seen += np.bincount(shard, minlength=shards)
            yield batch[kept].assign(shard=shard, grown_shard=jump(keys, shards + 1), local=local)

    placed = cut(restored(rows.mapInPandas(number, f"{types}, shard int, grown_shard int, local long"), numbers))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
        .select("part", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    return placed.join(offsets, ["part", "shard"]).select(
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
        "shard", (F.col("local") + F.col("before")).alias("slot"), "grown_shard",
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document in its shard by ``doc_id``; size is UTF-8 bytes of the text plus 1.

    A null text has size 1 and the checksum of nothing; documents with the same or a null
    doc_id share a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign(sized, ["doc_id"], shards, ["doc_id", "size", "text_crc32", "law"])
