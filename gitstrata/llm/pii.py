"""Personal data: wide generators propose spans, boosted trees and a calibrated threshold choose.

The base rules (address, ip, card, phone) always stay.  Wider generators propose look-alikes;
what the base rules confirm teaches the trees which formats and contexts are real, and
look-alikes outside base spans are added when the calibrated score says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm import spans

# The base patterns.  Possessive forms of the given ones, which match the same
# places: a name run can only start after another character or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ADDRESS = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

# Generators of wider candidates: each also finds most of what a base rule confirms.
GENERATORS = {
    "mail_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,63}+"
                 r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip_like": r"(?<![0-9.])[0-9]{1,3}+(?:[.][0-9]{1,3}+){3}+(?![0-9])",
    "number_like": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "phone_like": r"(?:\+[0-9]{1,3}[\x20.-]?)?+\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "id_like": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDS = {"email": "@", "phone": "+"}
CUES = r"(?i)(?:mail|phone|tel|call|card|visa|ssn|iban|account|address|contact|host|\bip\b)"
CONTEXT = 32  # characters of context before a candidate

ROUNDS, DEPTH, RATE = 24, 2, 0.3
PRECISION = 0.99  # calibrated share of added spans that must be right
EVIDENCE = 20  # confirmed candidates of the held-out fold a threshold must rest on

FEATURES = ["gen", "digits", "seps", "luhn", "octets", "edge_before", "edge_after", "cue"]


def base_spans(found: DataFrame) -> DataFrame:
    """Keep the matches that pass their kind's test."""
    count = lambda x: F.length(spans.digits_of(x["hit"]))
    return found.withColumns({
        "ip": F.filter("ip", lambda x: x["hit"].rlike(ADDRESS)),
        "card": F.filter("card", lambda x: F.when(count(x).between(14, 19), spans.luhn(spans.digits_of(x["hit"])))
                         .otherwise(F.lit(False))),
        "phone": F.filter("phone", lambda x: count(x).between(10, 15)),
    })


def proposed() -> Column:
    """All generators' spans of a text, with what stands around them."""
    return F.concat(*[_with_context(i, g) for i, g in enumerate(GENERATORS)])


def _with_context(number: int, generator: str) -> Column:
    text = F.col("text")
    return F.transform(generator, lambda x: F.struct(
        F.lit(number).alias("gen"), x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"),
        F.substring(text, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(x["start"], F.lit(CONTEXT))).alias("before"),
        F.substring(text, x["stop"] + 1, F.lit(1)).alias("after"),
    ))


def candidates(found: DataFrame) -> DataFrame:
    """One row per candidate with its features and ``real``: it overlaps a base span."""
    rows = found.where("size(wide) > 0").select("row", "base", F.explode("wide").alias("c")).select("row", "base", "c.*")
    n = F.length(spans.digits_of(F.col("hit")))
    digits = spans.digits_of(F.col("hit"))
    edge = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s,;:()<>\"'\[\]]$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 2).otherwise(3)
    return rows.select(
        "row", "start", "stop",
        "gen",
        F.when(n < 9, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).otherwise(4).alias("digits"),
        F.least(F.lit(3), F.length(F.regexp_replace("hit", r"[A-Za-z0-9]", ""))).alias("seps"),
        F.when((n >= 12) & spans.luhn(digits), 1).otherwise(0).alias("luhn"),
        F.when(F.col("hit").rlike(ADDRESS), 1).otherwise(0).alias("octets"),
        edge(F.right("before", F.lit(1))).alias("edge_before"),
        edge(F.col("after")).alias("edge_after"),
        F.when(F.col("before").rlike(CUES), 1).otherwise(0).alias("cue"),
        F.exists("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"])).alias("real"),
    )


Tree = tuple | float


class Trees:
    """Boosted regression trees on counted rows: (features, real, seen)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]]) -> None:
        real, seen = sum(r for _, r, _ in rows), sum(n for _, _, n in rows)
        prior = min(max(real / seen, 1e-4), 1 - 1e-4)
        self.start = math.log(prior / (1 - prior))
        self.trees: list[Tree] = []
        scores = [self.start] * len(rows)
        for _ in range(ROUNDS):
            slopes = []
            for (x, r, n), s in zip(rows, scores, strict=True):
                p = 1 / (1 + math.exp(-s))
                slopes.append((x, r - n * p, n * p * (1 - p)))
            tree = self._grow(slopes, DEPTH)
            self.trees.append(tree)
            scores = [s + self._of(tree, x) for (x, _, _), s in zip(rows, scores, strict=True)]

    @classmethod
    def _grow(cls, rows: list, depth: int) -> Tree:
        gain = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for _, _, h in part) + 1.0)
        best = (1e-6, None)
        if depth:
            for f in range(len(FEATURES)):
                for v in sorted({x[f] for x, _, _ in rows})[1:]:
                    low, high = [r for r in rows if r[0][f] < v], [r for r in rows if r[0][f] >= v]
                    if (won := gain(low) + gain(high) - gain(rows)) > best[0]:
                        best = (won, (f, v, low, high))
        if best[1] is None:
            return RATE * sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1.0)
        f, v, low, high = best[1]
        return f, v, cls._grow(low, depth - 1), cls._grow(high, depth - 1)

    @classmethod
    def _of(cls, tree: Tree, x: tuple[int, ...]) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(self._of(t, x) for t in self.trees)

    def column(self) -> Column:
        def of(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            return F.when(F.col(FEATURES[tree[0]]) < tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + of(t)
        return total


def fit(counted: DataFrame) -> tuple[Trees, float] | None:
    """Trees and the lowest score whose held-out precision reaches ``PRECISION``.

    Candidates of all documents are counted per feature vector before they leave Spark:
    the features have 6 x 5 x 4 x 2 x 2 x 4 x 4 x 2 values, which bounds what is collected.
    Every third document calibrates, the others teach.  None where either class is missing.
    """
    counts = counted.groupBy((F.col("row") % 3 == 0).alias("held"), *FEATURES).agg(
        F.sum(F.col("real").cast("double")).alias("r"), F.count("*").cast("double").alias("n")
    ).collect()
    rows = {h: [(tuple(c[f] for f in FEATURES), c["r"], c["n"]) for c in counts if c["held"] == h] for h in (False, True)}
    real, seen = sum(r for _, r, _ in rows[False]), sum(n for _, _, n in rows[False])
    if not 0 < real < seen or not rows[True]:
        return None
    trees = Trees(rows[False])
    right = total = 0.0
    least = None
    for score, r, n in sorted(((trees.score(x), r, n) for x, r, n in rows[True]), reverse=True):
        right, total = right + r, total + n
        if right >= EVIDENCE and right >= PRECISION * total:
            least = score
    return None if least is None else (trees, least)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, checksum of the base spans, all spans, and their number.

    A null or empty text has no spans; repeated and null ids are documents of their own.
    The text is read once; what is kept and regrouped is spans only.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = base_spans(spans.find(text, "text", BASE, NEEDS))
    kinds = [(k, F.col(k)) for k in BASE]
    kept = cut(spans.find(found, "text", GENERATORS).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        spans.ordered(kinds).alias("base"), proposed().alias("wide"),
    ))
    wide = candidates(kept)
    model = fit(wide)
    result = kept.select("row", "doc_id", *[f"n_{k}" for k in BASE], "base")
    if model is None:
        result = result.withColumn("added", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>"))
    else:
        trees, least = model
        added = wide.where(~F.col("real") & (trees.column() >= least)).groupBy("row").agg(
            F.array_sort(F.collect_set(F.struct(
                "start", (F.col("gen") + len(BASE)).alias("rank"), "stop",
                F.element_at(F.array(*[F.lit(g) for g in GENERATORS]), F.col("gen") + 1).alias("kind"),
            ))).alias("added")
        )
        result = result.join(added, "row", "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return result.select(
        "doc_id", *[f"n_{k}" for k in BASE],
        F.sha2(spans.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans.written(every).alias("spans"), F.size(every).cast("long").alias("n_spans"),
    )
