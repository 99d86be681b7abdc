"""Hard negatives of anchors by exact inner-product search in cover trees.

Candidates get one more component that makes all norms equal, so they lie on one sphere.  A
tree node is a candidate with the covering radius of everything below it, once on the sphere
(as an angle) and once among the plain vectors; each bounds the inner products below the node
from both sides.  A search takes nodes in the order of their upper bounds, skips those that
lie outside all wanted windows of scores, and computes exact scores in the leaves.

The upper level of the tree is a table of few pivots that every task knows.  Below a pivot,
candidates of one label form trees of bounded size.  A query first visits its best pivot;
what it finds there raises the windows' lower ends before the other pivots are visited.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut

SCALE = 256  # components are floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # window of a negative's score, percent of the positive's
PIVOTS = 256  # pivots of the upper level at most
DRAWN = 16  # vectors drawn for every pivot; only pivots are chosen from them, all candidates are indexed
BLOCK = 8192  # candidates of a tree, about
QUERIES = 2048  # queries that one task asks of one tree, about
FANOUT = 32  # children of a node at most
SHRINK = 0.7  # children's covering radius against their parent's, unless FANOUT ends it
LEAF = 128  # candidates of a leaf at most, but for equal ones
NONE = -(2**62)
TREE = ["pivot", "kind", "part"]


def whole(vector: str, scale: int) -> Column:
    """Whole-number components, or null where a component is null, not finite or too large to score in a long."""
    real = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**31 - 1)))
    norm = F.aggregate(real, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(fine & (norm < float(2**61)), F.transform(real, lambda x: F.floor(x).cast("int")))


def stacked(vectors, size: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector is filled up with zeros."""
    out = np.zeros((len(vectors), size), dtype=np.int64)
    for i, v in enumerate(vectors):
        v = np.frombuffer(v, dtype="<i4") if isinstance(v, bytes) else np.asarray(v)
        out[i, :len(v)] = v
    return out


@dataclass
class Sphere:
    """Norm of all candidates after one more component."""

    norm: float

    def more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))

    def radii(self, x: np.ndarray, more: np.ndarray, c: np.ndarray, c_more: float) -> tuple[np.ndarray, np.ndarray]:
        """Plain distance and angle on the sphere from every row to one centre."""
        plain = ((x - c).astype(np.float64) ** 2).sum(axis=1)
        chord = np.sqrt(plain + (more - c_more) ** 2)
        return np.sqrt(plain), 2 * np.arcsin(np.minimum(chord / (2 * self.norm), 1.0)) if self.norm else np.zeros(len(x))

    def bounds(self, scores: np.ndarray, length: float, plain: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product below nodes whose centres have these scores with a query of that length."""
        high, low = scores + length * plain, scores - length * plain
        most = length * self.norm
        if most:
            to = np.arccos(np.clip(scores / most, -1, 1))
            high = np.minimum(high, most * np.cos(np.maximum(0, to - angle)))
            low = np.maximum(low, most * np.cos(np.minimum(np.pi, to + angle)))
        slack = 1e-6 * most + 1e-3
        return low - slack, high + slack


def far_first(x: np.ndarray, more: np.ndarray, start: int, sphere: Sphere, count: int, within: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Centres, each the row farthest from those before, until all rows are ``within`` or ``count`` is reached; rows' centres."""
    centres, owner = [start], np.zeros(len(x), dtype=np.int64)
    near = sphere.radii(x, more, x[start], more[start])[1]
    while len(centres) < count and near.max() > within:
        k = int(near.argmax())
        far = sphere.radii(x, more, x[k], more[k])[1]
        owner[far < near] = len(centres)
        near = np.minimum(near, far)
        centres.append(k)
    return centres, owner


class CoverTree:
    """Nodes in arrays: centre, covering radii, and children or the rows of a leaf."""

    def __init__(self, x: np.ndarray, ids: list, sphere: Sphere) -> None:
        more, order = sphere.more(x), []
        found: list[list] = []  # centre, plain radius, angle, first child, children, first row, end row
        waiting = [(np.arange(len(x)), 0)]
        at = 0
        while at < len(waiting):
            rows, centre = waiting[at]
            plain, angle = sphere.radii(x[rows], more[rows], x[centre], more[centre])
            node = [centre, plain.max(), angle.max(), 0, 0, 0, 0]
            if len(rows) > LEAF and angle.max() > 0 and plain.max() > 0:
                start = int(np.flatnonzero(rows == centre)[0])
                centres, owner = far_first(x[rows], more[rows], start, sphere, FANOUT, SHRINK * angle.max())
                if len(centres) > 1:
                    node[3], node[4] = len(waiting), len(centres)
                    waiting += [(rows[owner == k], int(rows[c])) for k, c in enumerate(centres)]
            if not node[4]:
                node[5], node[6] = len(order), len(order) + len(rows)
                order += rows.tolist()
            found.append(node)
            at += 1
        nodes = list(zip(*found, strict=True))
        self.sphere, self.x = sphere, x[order].astype(np.int32)
        self.centres = x[list(nodes[0])].astype(np.int32)
        self.plain, self.angle = np.asarray(nodes[1]), np.asarray(nodes[2])
        self.child, self.children, self.first, self.end = (np.asarray(n, dtype=np.int64) for n in nodes[3:])
        self.ids = [ids[i] for i in order]

    def opened(self) -> CoverTree:
        """Vectors as doubles where all scores fit them exactly, else as longs; before the first search."""
        kind = np.float64 if self.sphere.norm < 2**26 else np.int64
        self.x, self.centres = self.x.astype(kind), self.centres.astype(kind)
        return self

    def search(self, query: np.ndarray, low: list[int], high: list[int], most: int) -> list[list[tuple[int, int]]]:
        """For each window of scores its first ``most`` (minus score, id), by score and then smaller id."""
        q, length = query.astype(self.x.dtype), float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        low, best = list(low), [[] for _ in low]
        least, top = min(low), max(high)
        lo, hi = self.sphere.bounds((self.centres[:1] @ q).astype(np.float64), length, self.plain[:1], self.angle[:1])
        heap = [(-hi[0], lo[0], 0)]
        while heap:
            up, down, node = heapq.heappop(heap)
            if -up < least:
                break
            if not any(-up >= l and down <= h for l, h in zip(low, high, strict=True)):
                continue
            if n := self.children[node]:
                c = self.child[node]
                kids = slice(c, c + n)
                lo, hi = self.sphere.bounds((self.centres[kids] @ q).astype(np.float64), length, self.plain[kids], self.angle[kids])
                for k in np.flatnonzero((hi >= least) & (lo <= top)):
                    heapq.heappush(heap, (-hi[k], lo[k], c + k))
                continue
            first = self.first[node]
            scores = self.x[first:self.end[node]] @ q
            if scores.max() < least:
                continue
            for w, (l, h) in enumerate(zip(low, high, strict=True)):
                rows = np.flatnonzero((scores >= l) & (scores <= h))
                if len(rows):
                    if len(rows) > most:
                        rows = rows[scores[rows] >= np.partition(scores[rows], -most)[-most]]
                    best[w] = sorted(set(best[w]).union((-int(scores[r]), i) for r in rows for i in self.ids[first + r]))[:most]
                    if len(best[w]) == most:
                        low[w] = -best[w][-1][0]
            least = min(low)
        return best


@dataclass
class Index:
    """Pivots with their covering radii, and the trees below them."""

    sphere: Sphere
    size: int
    pivots: np.ndarray
    plain: np.ndarray
    angle: np.ndarray
    trees: DataFrame  # pivot, kind (label), part, tree


def build(candidates: DataFrame) -> Index | None:
    """Index of all candidates (kind, q, ids); None if there are none.

    Pivots are chosen, farthest first, among DRAWN times as many vectors drawn by hash; all
    candidates then go below their nearest pivot.
    """
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    n, size, norm = candidates.agg(F.count("*"), F.max(F.size("q")), F.max(norm)).first()
    if not n:
        return None
    count = min(PIVOTS, max(1, n // BLOCK))
    drawn = candidates.select("q").orderBy(F.xxhash64("q"), "q").limit(DRAWN * count).collect()
    sphere, x = Sphere(float(np.sqrt(float(norm)) * (1 + 1e-12))), stacked([r.q for r in drawn], size)
    pivots = x[far_first(x, sphere.more(x), 0, sphere, count)[0]]
    more = sphere.more(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            x = stacked(batch["q"], size)
            own = sphere.more(x)
            far = [sphere.radii(x, own, p, m) for p, m in zip(pivots, more, strict=True)]
            plain, angle = (np.asarray([f[i] for f in far]) for i in (0, 1))
            nearest, here = angle.argmin(axis=0), np.arange(len(x))
            raw = [v.astype("<i4").tobytes() for v in x]
            yield batch[["kind", "ids"]].assign(pivot=nearest, q=raw, plain=plain[nearest, here], angle=angle[nearest, here])

    placed = cut(candidates.mapInPandas(place, "kind long, ids array<long>, pivot int, q binary, plain double, angle double"))
    radii = {r.pivot: (r.plain, r.angle) for r in placed.groupBy("pivot").agg(F.max("plain").alias("plain"), F.max("angle").alias("angle")).collect()}
    plain, angle = (np.asarray([radii.get(p, (-np.inf, -np.inf))[i] for p in range(len(pivots))]) for i in (0, 1))
    cells = placed.groupBy("pivot", "kind").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = placed.join(cells, ["pivot", "kind"]).withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int"))

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(stacked(rows["q"], size), [list(map(int, i)) for i in rows["ids"]], sphere)
        return rows[TREE].iloc[:1].assign(tree=pickle.dumps(tree))

    trees = cut(dealt.select(*TREE, "q", "ids").groupBy(*TREE).applyInPandas(plant, "pivot int, kind long, part int, tree binary"))
    return Index(sphere, size, pivots, plain, angle, trees)


def _visits(index: Index, queries: DataFrame, best: bool) -> DataFrame:
    """Queries once for every pivot that a window may reach: the best one, or all others."""
    pivots, sphere, size, plain, angle = index.pivots.astype(np.float64), index.sphere, index.size, index.plain, index.angle

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            to = []
            for q, lows, highs in zip(stacked(batch["q"], size).astype(np.float64), batch["low"], batch["high"], strict=True):
                scores = pivots @ q
                lo, hi = sphere.bounds(scores, float(np.linalg.norm(q)), plain, angle)
                reached = (plain >= 0) & ((hi[:, None] >= np.asarray(lows)) & (lo[:, None] <= np.asarray(highs))).any(axis=1)
                at = np.flatnonzero(reached)
                first = at[scores[at].argmax()] if len(at) else -1
                to.append(at[at == first] if best else at[at != first])
            yield batch.assign(to=to)

    sent = queries.mapInPandas(route, f"{', '.join(f'{n} {t}' for n, t in queries.dtypes)}, to array<int>")
    return sent.withColumn("pivot", F.explode("to")).drop("to")


def _asked(index: Index, visits: DataFrame, same: bool, most: int, slices: int) -> DataFrame:
    """id, w, score and found of every window's first ``most`` in each tree that is visited."""
    names = index.trees.select(*[F.col(c).alias(f"_{c}") for c in TREE])
    labels = F.col("label") == F.col("_kind") if same else F.col("label") != F.col("_kind")
    each = visits.join(names, (F.col("pivot") == F.col("_pivot")) & labels).select(
        *[F.col(f"_{c}").alias(c) for c in TREE], F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "q", "low", "high"
    )
    keys = [*TREE, "slice"]
    met = each.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.lit(1))
    needed = index.trees.join(met, [F.col(k) == F.col(f"_{k}") for k in TREE]).select(*TREE, F.col("_slice").alias("slice"), "tree")
    size = index.size

    def ask(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        tree, out = pickle.loads(trees["tree"].iloc[0]).opened(), []
        for one, q, low, high in zip(queries["id"], stacked(queries["q"], size), queries["low"], queries["high"], strict=True):
            for w, best in enumerate(tree.search(q, list(low), list(high), most)):
                out += [(one, w, -minus, found) for minus, found in best]
        return pd.DataFrame(out, columns=["id", "w", "score", "found"])

    return needed.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(ask, "id long, w int, score long, found long")


def first_of(rows: DataFrame, keys: list[str], most: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def search(index: Index, queries: DataFrame, same: bool, most: int, slices: int) -> DataFrame:
    """For each query and window w the first ``most`` (score, found) among its own label, or all other labels.

    ``queries``: id, label, q (bytes), low and high (arrays, one entry a window).
    """
    near = cut(first_of(_asked(index, _visits(index, queries, True), same, most, slices), ["id", "w"], most))
    if len(index.pivots) == 1:
        return near
    full = near.groupBy("id", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= most)
    raised = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
    low = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("least", w.cast("int")), x)))
    rest = queries.join(raised, "id", "left").withColumn("low", low).select(*queries.columns)
    more = _asked(index, _visits(index, rest, False), same, most, slices)
    return cut(first_of(near.drop("rank").union(more), ["id", "w"], most))


def mine(
    vectors: DataFrame, *, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding, anchor (whether the row is an anchor).  Rows with a
    null vec_id, label or vector, or with a null, non-finite or huge component (a squared norm
    of 2**61 after scaling) take no part.  A vector counts as filled up with zeros to the
    longest one.  Rows equal in vec_id, label and components are one row.  An anchor without
    positives, a negative positive score (its window is empty) and an empty table give no rows.
    Other columns are ignored.

    Equal vectors of one label are one candidate with its smallest ids, no more than can be
    returned, and anchors of one label and vector are one query: copies cost nothing.
    """
    taken = vectors.select("vec_id", F.col("label").cast("long").alias("label"), whole("embedding", scale).alias("q"), "anchor")
    rows = cut(taken.where("vec_id is not null and label is not null and q is not null"))
    most = max(positives + 1, negatives)
    place = F.dense_rank().over(Window.partitionBy("label", "q").orderBy("vec_id"))
    candidates = cut(
        rows.select("label", "q", F.col("vec_id").cast("long").alias("vec_id"), place.alias("place")).where(F.col("place") <= most)
        .groupBy(F.col("label").alias("kind"), "q").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    index = build(candidates)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return vectors.sparkSession.createDataFrame([], shape)
    anchors = rows.where("anchor").select(F.col("vec_id").cast("long").alias("anchor_id"), "label", "q").distinct()
    asked = anchors.groupBy("label", "q").agg(F.min("anchor_id").alias("id"))
    size = index.size

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            yield batch.assign(q=[v.astype("<i4").tobytes() for v in stacked(batch["q"], size)])

    open_ = F.array(F.lit(NONE).cast("long")).alias("low"), F.array(F.lit(-NONE).cast("long")).alias("high")
    queries = cut(asked.select("id", "label", "q").mapInPandas(pack, "id long, label long, q binary"))
    slices = max(1, -(-queries.count() // QUERIES))
    top = search(index, queries.select("*", *open_), True, positives + 1, slices).select("id", "score", "found")
    own = anchors.join(asked, ["label", "q"]).select("anchor_id", "id").distinct()
    pairs = own.join(top, "id").where("found != anchor_id")
    pairs = cut(first_of(pairs, ["anchor_id", "id"], positives, "nth").where("score >= 0").select(
        "anchor_id", "id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    windows = pairs.groupBy("id").agg(F.array_sort(F.collect_set("positive_score")).alias("top"))
    least = F.transform("top", lambda s: (s * low + 99 - F.pmod(s * low + 99, F.lit(100))) / 100)
    upper = F.transform("top", lambda s: (s * high - F.pmod(s * high, F.lit(100))) / 100)
    narrow = queries.join(windows, "id").select(
        "id", "label", "q", least.cast("array<long>").alias("low"), upper.cast("array<long>").alias("high"), "top"
    )
    found = search(index, narrow.drop("top"), False, negatives, slices)
    hits = found.join(narrow.select("id", "top"), "id").select(
        "id", F.element_at("top", F.col("w") + 1).alias("positive_score"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return pairs.join(hits, ["id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
