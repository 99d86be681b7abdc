"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A rotated vector is cut into two blocks with a random code book each; a pair of code words is
one filter direction.  Every vector is decoded to all filters it exceeds the threshold on,
vectors meet under each common filter, and cosines are computed exactly there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.graph import components
from gitstrata.llm.meetings import MEETING, arrange, whole_meetings
from gitstrata.llm.sized import sized

COSINE = 0.9
FILTERS = 24  # expected filters of a vector: more find more, and cost more
BUCKET = 1024  # expected vectors of a filter
TURNS = 4  # independent rotations, each with code books of its own, that share out the filters
CHUNK = 1024  # vectors of one filter compared in one piece; larger groups piece by piece
SEED = 20


@functools.cache
def codes(turn: int, size: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and two code books for vectors of one size, the same in every task."""
    rng = np.random.default_rng([SEED, turn, size, words])
    half = (size + 1) // 2
    books = []
    for width in (half, size - half):
        book = rng.standard_normal((words, width))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-9) * math.sqrt(width / size))
    return np.linalg.qr(rng.standard_normal((size, size)))[0], books[0], books[1]


def scores(unit: np.ndarray, turn: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    rotation, first, second = codes(turn, unit.shape[1], words)
    moved, half = unit @ rotation, first.shape[1]
    return moved[:, :half] @ first.T, moved[:, half:] @ second.T


@functools.cache
def level(size: int, words: int, share: float) -> float:
    """The score that a random unit vector reaches on ``share`` of the filters."""
    sample = np.random.default_rng([SEED, size]).standard_normal((100, size))
    a, b = scores(sample / np.linalg.norm(sample, axis=1, keepdims=True), 0, words)
    return float(np.quantile((a[:, :, None] + b[:, None, :]).ravel(), 1 - share))


def decode(unit: np.ndarray, words: int, share: float) -> list[np.ndarray]:
    """All filter numbers of each unit vector: pairs of code words whose scores reach the level."""
    most = level(unit.shape[1], words, share)
    found: list[list[np.ndarray]] = [[] for _ in unit]
    for turn in range(TURNS):
        for of, x, y in zip(found, *scores(unit, turn, words), strict=True):
            rows = np.flatnonzero(x >= most - y.max())  # only these can reach it with some second word
            i, j = np.nonzero(x[rows, None] + y[None, :] >= most)
            of.append(np.sort(rows[i] * words + j) + turn * words**2)
    return [np.concatenate(of) for of in found]


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=kind) for r in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Whether a vector has only finite components and is not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near(vectors: DataFrame, cosine: float = COSINE, filters: int = FILTERS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Equal vectors are one node with a number of copies, linked with each other.  Vectors that
    are null, zero or hold null or non-finite components link with nothing, nor do vectors of
    different sizes.  A pair counts once, under the first filter its two vectors share.
    A null vec_id takes part and names no component unless nothing else can; it is kept.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, wide = ("<f4", "float") if single else ("<f8", "double")
    rows = cut(vectors.select("vec_id", F.col("embedding").cast(f"array<{wide}>").alias("v")).withColumn("ok", usable("v")))
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("v")))
    nodes = cut(rows.where("ok").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies")))
    total = max(nodes.count(), 1)
    words = max(6, math.ceil(math.sqrt(total * filters / (TURNS * BUCKET))))
    share = min(0.5, filters / (TURNS * words**2))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                raw = [np.asarray(v, dtype=kind).tobytes() for v in part["v"]]
                found = decode(unit_rows(raw, kind), words, share)
                yield part[["node", "copies"]].assign(raw=raw, under=[(int(size) << 40) + f for f in found])

    listed = cut(nodes.mapInPandas(spread, "node long, copies long, raw binary, under array<long>"))
    each = listed.select(F.explode("under").alias("key"), "node", "copies", "raw", "under")
    # Only filters with more than a chunk of vectors are cut up; these are few, or joined by shuffle.
    hot = sized(
        listed.select(F.explode("under").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out = [_links(group, cosine, kind) for _, group in rows.groupby(MEETING, sort=False) if len(group) > 1]
        return pd.concat(out, ignore_index=True) if out else NONE

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return whole_meetings(batches, meet)

    found = cut(arrange(each, hot, "node").mapInPandas(scan, "a long, b long, n long"))
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a != b"), "a", "b").select("node", "component")
    facts = nodes.select("node", "copies").join(degrees, "node", "left").join(joined, "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")
    )
    rooted = rows.where("ok").join(facts, "node").select("vec_id", "n_links", "root")
    names = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = rooted.join(names, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


NONE = pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)


def _links(group: pd.DataFrame, cosine: float, kind: str) -> pd.DataFrame:
    """Per vector of a meeting: (a, a, copies of new links) and (a, b, 0) to its smallest neighbour in reach."""
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    unit = unit_rows(group["raw"].tolist(), kind)
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    if group["i"].iloc[0] != group["j"].iloc[0]:
        part = group["part"].to_numpy()
        link &= part[:, None] != part[None, :]
    if not link.any():
        return NONE
    key = group["key"].iloc[0]
    before = [u[u < key] for u in group["under"]]
    flat = np.concatenate(before)
    new = link
    if len(flat):
        seen, col = np.unique(flat, return_inverse=True)
        has = np.zeros((len(group), len(seen)), dtype=np.float32)
        has[np.repeat(np.arange(len(group)), [len(b) for b in before]), col] = 1
        has = has[:, has.sum(axis=0) > 1]
        new = link & (has @ has.T == 0)
    label = np.arange(len(group))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(group)).min(axis=1))
        if (low == label).all():
            break
        label = low
    n = new @ copies
    far = label != np.arange(len(group))
    return pd.DataFrame({
        "a": np.concatenate([node[n > 0], node[far]]), "b": np.concatenate([node[n > 0], node[label[far]]]),
        "n": np.concatenate([n[n > 0], np.zeros(far.sum(), dtype=np.int64)]),
    })
