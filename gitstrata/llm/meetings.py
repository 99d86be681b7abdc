"""Rows of one key compared with each other in bounded pieces.

A group larger than a chunk is cut into chunks by hash; every two chunks meet in one piece,
so no task holds more than two chunks and a hot key spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEETING = ["key", "i", "j"]


def arrange(rows: DataFrame, hot: DataFrame, member: str) -> DataFrame:
    """``rows`` (key, member, ...) once per meeting of their chunk.

    ``hot`` (key, parts) has the keys with more rows than a chunk; others are one chunk.

    Adds part (own chunk) and i <= j (the chunks that meet), sorted so that a meeting's rows
    are neighbours inside one partition.
    """
    known = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = known.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    meeting = placed.withColumn("other", others).withColumns(
        {"i": F.least("part", "other"), "j": F.greatest("part", "other")}
    ).drop("other", "parts")
    return meeting.repartition(*MEETING).sortWithinPartitions(*MEETING, member)


def whole_meetings(batches: Iterator[pd.DataFrame], each: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Call ``each`` on runs of complete meetings; a batch's last one waits for its rest."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[MEETING] == rows[MEETING].iloc[-1]).all(axis=1).to_numpy()
        rest = rows[last].reset_index(drop=True)
        if not last.all():
            yield each(rows[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield each(rest)
