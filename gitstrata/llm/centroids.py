"""Whole-number k-means whose assignments go through a PCA-rotated filter.

Vectors are stored with their leading rotated coordinates and the norm of the rest.  For a
vector and a centroid, the squared distance of the leading coordinates plus the squared
difference of the two rest norms is never above their squared distance, so most centroids
are ruled out by a few coordinates; the others are measured in whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.carry import as_text, restored, whole_numbers

SIZE = 64  # components of a vector that takes part
SCALE = 64  # components are floor(SCALE * x)
CENTROIDS = 16
ROUNDS = 3
LEADING = 12  # rotated coordinates that are stored; more rule out more, and cost more
EXACT = "decimal(38,0)"


def largest(size: int) -> int:
    """Components below this give squared distances that fit 62 bits."""
    return math.isqrt(2**62 // size) // 2


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the whole-number components, of the vectors that take part."""
    real = F.transform("embedding", lambda x: x.cast("double") * scale)
    fine = F.forall("real", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(largest(size))))
    taken = F.coalesce((F.size("real") == size) & fine, F.lit(False))
    return vectors.select("vec_id", real.alias("real")).where(taken).select(
        "vec_id", F.transform("real", lambda x: F.floor(x).cast("int")).alias("q")
    )


def matrix(arrays: pd.Series, size: int) -> np.ndarray:
    return np.stack(arrays.to_numpy()).astype(np.int64) if len(arrays) else np.zeros((0, size), dtype=np.int64)


def rotation(whole: DataFrame, size: int) -> np.ndarray:
    """Principal directions of all vectors, strongest first, as columns.

    Every task gives one row of sums per component; what reaches the driver is one number per
    pair of components.  Any rotation keeps the bound, so rounding here can't change results.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size))
        n = 0
        for batch in batches:
            x = matrix(batch["q"], size).astype(np.float64)
            total += np.vstack([x.T @ x, x.sum(axis=0)])
            n += len(x)
        if n:
            yield pd.DataFrame({"i": range(size + 1), "n": n, "sums": list(total)})

    parts = whole.select("q").mapInPandas(moments, "i int, n long, sums array<double>")
    cells = parts.select("i", "n", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total, n = np.zeros((size + 1, size)), 1
    for r in cells.collect():
        total[r.i, r.j], n = r.s, r.n
    mean = total[size] / n
    return np.linalg.eigh(total[:size] / n - np.outer(mean, mean))[1][:, ::-1]


def projected(x: np.ndarray, turn: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    moved = x.astype(np.float64) @ turn
    return moved[:, :leading], np.linalg.norm(moved[:, leading:], axis=1)


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, squared distance, pairs measured); ties go to the smaller number."""
    centre_lead, centre_rest = projected(centres, turn, lead.shape[1])
    low = (rest[:, None] - centre_rest[None, :]) ** 2
    for j in range(lead.shape[1]):
        low += (lead[:, j, None] - centre_lead[None, :, j]) ** 2
    norms = (lead**2).sum(axis=1) + rest**2
    low -= 1e-9 * (norms[:, None] + (centre_lead**2).sum(axis=1) + centre_rest**2) + 1e-6
    number = low.argmin(axis=1)
    best = ((q - centres[number]) ** 2).sum(axis=1)
    measured, first = len(q), number.copy()
    for k in range(len(centres)):
        rows = np.flatnonzero((low[:, k] <= best) & (first != k))
        far = ((q[rows] - centres[k]) ** 2).sum(axis=1)
        better = (far < best[rows]) | ((far == best[rows]) & (k < number[rows]))
        best[rows[better]], number[rows[better]] = far[better], k
        measured += len(rows)
    return number, best, measured


def first_centres(whole: DataFrame, count: int) -> np.ndarray:
    """The vectors whose hashed vec_id is smallest; a null vec_id can't start a cluster."""
    order = [F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), "q"]
    rows = whole.where("vec_id is not null").orderBy(*order).limit(count).select("q").collect()
    return np.asarray([r.q for r in rows], dtype=np.int64)


def moved_centres(stored: DataFrame, centres: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Floor of the mean of every centre's vectors; a centre without vectors stays."""
    size = centres.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(centres.shape, dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        for batch in filter(len, batches):
            q, lead, rest = matrix(batch["q"], size), np.stack(batch["lead"].to_numpy()), batch["rest"].to_numpy()
            number = nearest(q, lead, rest, centres, turn)[0]
            n += np.bincount(number, minlength=len(centres))
            for k in np.unique(number):
                total[k] += q[number == k].sum(axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some, "n": n[some], "sums": list(total[some])})

    parts = stored.select("q", "lead", "rest").mapInPandas(sums, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(EXACT)).alias("s")
    )
    out = centres.copy()
    for r in cells.collect():
        out[r.cluster, r.j] = int(r.s) // r.n
    return out


def _of(values: list, kind: str) -> Column:
    """Literal per cluster number."""
    return F.create_map(*[F.lit(x) for k, v in enumerate(values) for x in (k, v)])[F.col("cluster")].cast(kind)


def cluster(
    vectors: DataFrame, *, size: int = SIZE, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, leading: int = LEADING,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors that are null, have another number of components, or hold null, non-finite or
    such large components that squared distances don't fit a long take no part.  Repeated
    rows are vectors of their own; equal hashes of starting vectors are ordered by the
    components.  With fewer than ``count`` vectors each starts a cluster.  Null ids are
    clustered but start none; without any start there are no rows, as for an empty table.
    Other columns are ignored.  Nothing but sums per cluster and component reaches the driver.
    """
    whole = whole_vectors(vectors, size, scale)
    centres = first_centres(whole, count)
    out = "cluster int, distance long"
    types = whole_numbers(whole, ["vec_id"])
    kind = whole.schema["vec_id"].dataType.simpleString()
    if not len(centres):
        return whole.where("false").select(
            "vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        )
    turn = rotation(whole, size)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lead, rest = projected(matrix(batch["q"], size), turn, leading)
                yield batch.assign(lead=list(lead), rest=rest)

    text = as_text(whole, ["vec_id"])
    text_kind = text.schema["vec_id"].dataType.simpleString()
    stored = cut(text.mapInPandas(store, f"vec_id {text_kind}, q array<int>, lead array<double>, rest double"))
    for _ in range(rounds):
        centres = moved_centres(stored, centres, turn)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                number, far, _ = nearest(matrix(batch["q"], size), np.stack(batch["lead"].to_numpy()), batch["rest"].to_numpy(), centres, turn)
                yield batch[["vec_id"]].assign(cluster=number.astype(np.int32), distance=far)

    assigned = cut(restored(stored.mapInPandas(assign, f"vec_id {text_kind}, {out}"), types))
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return assigned.select(
        F.col("vec_id").cast(kind).alias("vec_id"), "cluster", "distance",
        _of([sums.get(k, 0) for k in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), _of(names, "string").alias("centroid_sha256"),
    )
