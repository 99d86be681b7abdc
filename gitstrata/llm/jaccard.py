"""Exact n-gram Jaccard join over parity sketches.

Every shingle of a set flips one bit of its sketch, so the Hamming distance of two sketches
is at most the size of the sets' symmetric difference.  Sets of similar size (a band) that
may differ in d shingles are cut into more than d blocks by hash: linked sets have an equal
block.  Sets that share a block are compared by a short whole sketch, then by a long one that
follows the size of the set, what passes is verified on the full sets, and links are closed
into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.carry import as_text, restored, whole_numbers
from gitstrata.llm.graph import components
from gitstrata.llm.meetings import MEETING, arrange, whole_meetings
from gitstrata.llm.rows import without_repeated_rows
from gitstrata.llm.sized import freed, settled, sized

GROWTH = 1.4  # each size band ends that much above the one before
SHORT = 8  # 64-bit words of the whole sketch
SKETCH = [f"s{i}" for i in range(SHORT)]
FINE = 8  # bits of a long sketch for each shingle in which linked sets may differ, at least
ROUNDS = 2  # in which the components of a block are joined along their closest pairs, before all pairs left are compared
CHUNK = 512  # sets of one block value compared in one piece; larger groups are compared piece by piece

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x *= _B
        x ^= x >> U(27)
        x *= _C
        x ^= x >> U(31)
        return x


def hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words; working one out is cheaper than a look into a table of hundreds of thousands."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``words`` words; a shorter text is one run."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    n = min(words, len(parts))
    h = hashed(parts)
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out * _A + h[j:j + len(out)])
    return np.unique(out)


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when 100 * common >= percent * all."""

    words: int = 3
    percent: int = 90

    def differing(self, both: int | np.ndarray):
        """Most shingles in which linked sets with so many shingles in sum can differ."""
        return both * (100 - self.percent) // (100 + self.percent)

    def least_common(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """Least number of keys that linked sets of these sizes share: blocks of the larger one's band that no difference can reach."""
        tops = [1]
        while len(large) and tops[-1] < large.max():
            tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
        top = np.asarray(tops, dtype=np.int64)[np.searchsorted(tops, large)]
        return np.maximum(self.differing(2 * top) - self.differing(small + large), 0) + 1

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band, its largest size) of the own band, and of the next if a larger partner may be there."""
        band, top = 0, 1
        while top < n:
            band, top = band + 1, max(top + 1, int(top * GROWTH))
        found = [(band, top)]
        if n * 100 // self.percent > top:
            found.append((band + 1, max(top + 1, int(top * GROWTH))))
        return found

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """Hashed block values of a set, in its bands.

        A band has some blocks to spare, so that sets without more empty blocks than these
        need none of them as keys: linked sets then share a block that holds shingles.
        """
        out = []
        place, bit = mix(sets ^ _A) >> U(32), mix(sets ^ _B)
        for band, top in self.bands(len(sets)):
            most = int(self.differing(2 * top))
            if most == 0:
                continue
            spare = 1 + most // 32
            blocks = most + 1 + spare
            wide = 256 if blocks <= 16 else 64
            at = ((place * U(blocks)) >> U(32)).astype(np.int64)
            flips = np.bincount(at * wide + (bit & U(wide - 1)).astype(np.int64), minlength=blocks * wide)
            value = np.packbits((flips & 1).astype(np.uint8)).view(np.uint64).reshape(blocks, -1)
            key = np.full(blocks, band, dtype=np.uint64)
            key = mix(key * _A + np.arange(blocks, dtype=np.uint64))
            with np.errstate(over="ignore"):
                for i in range(value.shape[1]):
                    key = mix(key * _A + value[:, i])
            full = np.zeros(blocks, dtype=bool)
            full[at] = True
            out.append(key[full] if blocks - full.sum() <= spare else key)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def sketch(sets: np.ndarray, bits: int) -> np.ndarray:
    flips = np.bincount((mix(sets ^ _C) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def short_sketch(sets: np.ndarray) -> np.ndarray:
    return sketch(sets, 64 * SHORT)


def long_sketch(sets: np.ndarray, rule: Rule) -> bytes:
    """A power of two of bits, so that a longer sketch folds to the length of a shorter one."""
    bits = 64 * SHORT
    while bits < FINE * rule.differing(2 * len(sets)):
        bits *= 2
    return sketch(sets, bits).tobytes()


def sketches_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which long sketches differ, pair by pair, at the shorter one's length; never more than their sets differ in."""
    out = np.zeros(len(x), dtype=np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        kinds.setdefault((len(p), len(q)), []).append(i)
    for (p, q), rows in kinds.items():
        sides = []
        for side, size in ((x, p), (y, q)):
            words = np.frombuffer(b"".join(side[i] for i in rows), dtype=np.uint64).reshape(len(rows), -1)
            while size > min(p, q):
                size //= 2
                words = words[:, :size // 8] ^ words[:, size // 8:]
            sides.append(words)
        out[rows] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, set hash h, text hash, short sketch s0.., long sketch and block keys of every document."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()  # sets this task has given keys for: copies need none
        for batch in batches:
            n, h, short, long, keys = [], [], [], [], []
            for text in batch["text"]:
                sets = shingles(text, rule.words)
                n.append(len(sets))
                h.append(xxhash.xxh3_64_intdigest(sets.tobytes()))
                short.append(short_sketch(sets))
                new = len(sets) > 0 and h[-1] not in met
                keys.append(rule.keys(sets).view(np.int64) if new else np.zeros(0, dtype=np.int64))
                long.append(long_sketch(sets, rule) if new else None)
                met.add(h[-1])
            out = batch[["doc_id", "text_hash"]].assign(n=n, h=np.asarray(h, dtype=np.uint64).view(np.int64), long=long, keys=keys)
            words = np.asarray(short).reshape(-1, SHORT)
            yield out.assign(**{f"s{i}": words[:, i] for i in range(SHORT)})

    numbers = whole_numbers(docs, ["doc_id"])
    rows = as_text(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    shorts = ", ".join(f"s{i} long" for i in range(SHORT))
    signed = rows.mapInPandas(sign, f"doc_id {kind}, text_hash long, n long, h long, long binary, keys array<long>, {shorts}")
    return restored(signed, numbers)


def facts_of(signed: DataFrame) -> DataFrame:
    """One narrow row per different set: h, n and the short sketch."""
    return signed.where("n > 0").groupBy("h").agg(F.max("n").alias("n"), *[F.max(s).alias(s) for s in SKETCH])


def likely(pairs: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches don't rule a link out; no text is read."""
    side = lambda k: facts.select(F.col("h").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *SKETCH)])
    apart = F.lit(0)
    for s in SKETCH:
        apart = apart + F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}")))
    most = F.floor((F.col("a_n") + F.col("b_n")) * (100 - rule.percent) / (100 + rule.percent))
    fits = (apart <= most) & (F.abs(F.col("a_n") - F.col("b_n")) <= most)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b")


def compact(sets: np.ndarray) -> bytes:
    """A set as its sorted hashes cut to 40 bits, five bytes each: two sets of a thousand clash with odds of one in a million."""
    short = np.unique(sets >> U(24)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def expanded(packed: bytes) -> np.ndarray:
    five = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), dtype=np.uint8)
    wide[:, :5] = five
    return wide.view("<u8").ravel()


def longs_of(signed: DataFrame) -> DataFrame:
    """One row per different set: h, n and the long sketch."""
    return signed.where("long IS NOT NULL").groupBy("h").agg(F.max("n").alias("n"), F.first("long").alias("long"))


def closer(pairs: DataFrame, longs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose long sketches don't rule a link out; these are a small part of the sets."""
    sides = pairs.join(longs.toDF("b", "nb", "lb"), "b").join(longs.toDF("a", "na", "la"), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = sketches_apart(list(batch["la"]), list(batch["lb"]))
            yield batch.loc[apart <= rule.differing((batch["na"] + batch["nb"]).to_numpy()), ["a", "b"]]

    return sides.select("a", "b", "na", "nb", "la", "lb").mapInPandas(compare, "a long, b long")


def verify(docs: DataFrame, signed: DataFrame, longs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set hashes whose whole sets are similar enough.

    Sets are laid out by hash once; each pair that the long sketches let through then takes its
    second set to its first one.
    """
    pairs = settled(closer(pairs, longs, rule))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    one = sized(signed.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("text_hash").alias("t")))
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(one, "t").select("h", "text")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()  # copies of a text have nothing to add
        for batch in batches:
            new = [k not in met and not met.add(k) for k in batch["h"]]
            rows = batch[new]
            yield pd.DataFrame({"h": rows["h"], "full": [compact(shingles(t, rule.words)) for t in rows["text"]]})

    sets = texts.mapInPandas(expand, "h long, full binary").groupBy("h").agg(F.first("full").alias("full"))
    sides = pairs.join(sets.toDF("b", "fb"), "b").join(sets.toDF("a", "fa"), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, p = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["fa"], batch["fb"], strict=True):
                if a != first:
                    first, p = a, expanded(x)
                q = expanded(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= rule.percent * (len(p) + len(q) - common))
            yield batch.loc[keep, ["a", "b"]]

    return sides.select("a", "b", "fa", "fb").mapInPandas(compare, "a long, b long")


def forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of pairs of components, closest first, those that join what the ones before have not."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    ordered = pairs.sort_values(["apart", "a", "b"])
    low, high = np.minimum(ordered["ca"], ordered["cb"]), np.maximum(ordered["ca"], ordered["cb"])
    ordered = ordered.assign(low=low, high=high).drop_duplicates(["low", "high"])
    keep = np.zeros(len(ordered), dtype=bool)
    for i, (x, y) in enumerate(zip(ordered["low"].tolist(), ordered["high"].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[y], keep[i] = x, True
    return ordered[keep]


def close_pairs(grouped: DataFrame, rule: Rule, *, closest: bool) -> DataFrame:
    """Pairs of one block value in different components whose short sketches may be close enough.

    ``grouped``: key, h, comp, n, s0.., part (chunk of the set in a group) and i, j (the two
    chunks that meet).  Rows of a meeting are neighbours after sorting; each is compared with
    the ones after it, all meetings of a batch at once.  With ``closest`` only a forest of
    closest pairs is named, so a meeting gives fewer pairs than it has components.  Without, a
    pair must share as many keys as its sizes ask for.
    """
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows[MEETING] != rows[MEETING].shift()).any(axis=1).to_numpy()
        group = np.cumsum(new)
        size = np.bincount(group)[group] if len(group) else group
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        behind = size - (np.arange(len(rows)) - first) - 1
        h, comp, n = (rows[c].to_numpy() for c in ("h", "comp", "n"))
        part, cross = rows["part"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()
        short = rows[[f"s{k}" for k in range(SHORT)]].to_numpy(dtype=np.int64).view(np.uint64)
        a, b, far = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        step = 1
        here = np.flatnonzero(behind >= step)
        while len(here):
            there = here + step
            apart = np.bitwise_count(short[here] ^ short[there]).sum(axis=1)
            good = (comp[here] != comp[there]) & (apart <= rule.differing(n[here] + n[there]))
            good &= ~cross[here] | (part[here] != part[there])
            a.append(here[good])
            b.append(there[good])
            far.append(apart[good].astype(np.int64))
            step += 1
            here = here[behind[here] >= step]
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.where(h[a] < h[b], a, b), np.where(h[a] < h[b], b, a)
        if closest:
            found = {"a": h[a], "b": h[b], "ca": comp[a], "cb": comp[b], "apart": np.concatenate(far)}
            return forest(pd.DataFrame(found))[["a", "b"]].assign(times=1, need=1)
        need = rule.least_common(np.minimum(n[a], n[b]), np.maximum(n[a], n[b]))
        pairs = pd.DataFrame({"a": h[a], "b": h[b], "need": need})
        return pairs.groupby(["a", "b", "need"]).size().rename("times").reset_index()[["a", "b", "times", "need"]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return whole_meetings(batches, meet)

    found = grouped.mapInPandas(scan, "a long, b long, times long, need long")
    shared = found.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
    return shared.where("times >= need").select("a", "b")


def _open(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, h, comp, size) of block values whose sets still lie in several components."""
    known = sized(components(linked).select(F.col("node").alias("h"), "component"))
    named = members.join(known, "h", "left").select("key", "h", F.coalesce("component", "h").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    return settled(named.join(several.where("low < high").select("key", "size"), "key"))


def _met(opened: DataFrame, facts: DataFrame) -> DataFrame:
    hot = sized(opened.where(F.col("size") > CHUNK).select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("parts")).distinct())
    return arrange(opened.select("key", "h", "comp").join(facts, "h"), hot, "h")


def _members(keyed: DataFrame) -> DataFrame:
    """(key, low, h) of block values that several sets share; low is the smallest of these sets."""
    each = keyed.where("n > 0").select("h", F.explode("keys").alias("key"))
    lows = each.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = settled(lows.where("low < high").select("key", "low"))
    return each.join(shared, "key").distinct()


def _best(members: DataFrame) -> DataFrame:
    """Every set with the smallest set of the block it shares most often."""
    return (
        members.where("h != low").groupBy("h", "low").agg(F.count("*").alias("times"))
        .groupBy("h").agg(F.max(F.struct("times", "low")).alias("m"))
        .select(F.least("h", "m.low").alias("a"), F.greatest("h", "m.low").alias("b")).distinct()
    )


def _closest(opened: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """Closest pairs of components in the most frequent open block of their sets."""
    favourite = opened.groupBy("h").agg(F.max(F.struct("size", "key")).alias("m")).select("h", F.col("m.key").alias("key"))
    return close_pairs(_met(opened.join(favourite, ["h", "key"]), facts), rule, closest=True)


def links(docs: DataFrame, signed: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of set hashes that connect what the exact join connects.

    First every set is verified against the smallest set of the block it shares most often.
    Then components grow along closest pairs: in the most frequent open block of its sets, the
    components that meet name a forest, these few pairs are verified, and a round begins anew;
    what failed is not verified again.  Last, block values that still hold several
    components compare all their sets of different components, so no link is missed.  A
    group's sets are cut into chunks that meet in pairs, so no task holds more than two.

    ``members`` comes from ``_members``; it is the widest table, so no name keeps one that a
    round has replaced.
    """
    tried = settled(_best(members))
    facts, longs = settled(facts_of(signed)), settled(longs_of(signed))
    linked = settled(verify(docs, signed, longs, likely(tried, facts, rule), rule))
    members, tasks = members.select("key", "h"), max(tried.rdd.getNumPartitions(), linked.rdd.getNumPartitions())
    for _ in range(ROUNDS):
        opened = _open(members, linked)
        members = opened.select("key", "h")
        freed(docs.sparkSession)
        fresh = settled(_closest(opened, facts, rule).join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        tried = tried.union(fresh).coalesce(tasks)  # a union has the tasks of both sides, and rounds would add them up
        linked = settled(linked.union(verify(docs, signed, longs, fresh, rule)).coalesce(tasks))
    opened = _open(members, linked)
    del members
    freed(docs.sparkSession)
    rest = settled(close_pairs(_met(opened, facts), rule, closest=False).join(tried, ["a", "b"], "left_anti"))
    del opened
    freed(docs.sparkSession)
    return linked.union(verify(docs, signed, longs, rest, rule))


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n, component_id (smallest doc_id reachable by links) of every document."""
    keyed = settled(signatures(docs, rule))
    members = [settled(_members(keyed))]  # handed over by pop, so that no name here keeps it
    signed = settled(keyed.drop("keys"))
    del keyed
    joined = components(settled(links(docs, signed, members.pop(), rule)))
    rooted = signed.where("n > 0").select("doc_id", "text_hash", "n", "h").join(
        joined.select(F.col("node").alias("h"), "component"), "h", "left"
    ).select("doc_id", "text_hash", "n", F.coalesce("component", "h").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root").select("doc_id", "text_hash", "n", "component_id").union(
        signed.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"))
    )


def groups(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document.

    Equal sets are one node, so copies cost nothing beyond their first signature.  Texts that
    are null or without words are linked with nothing.  A null doc_id takes part but names no
    component unless nothing else can.
    """
    return grouped(docs, rule or Rule()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents that are first in their group; columns unchanged.

    Documents with a null doc_id or without words stay.  Of rows equal in doc_id and text one
    stays; rows of one doc_id with different texts are judged by their own texts.
    """
    gone = grouped(docs, rule).where("doc_id > component_id").select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    left = docs.withColumn("_text_hash", F.xxhash64("text")).join(sized(gone), ["doc_id", "_text_hash"], "left_anti")
    return without_repeated_rows(left.select(*docs.columns))
