"""One-permutation MinHash fingerprints of documents and of edited texts.

Every five-word shingle is hashed once; the hash's upper bits name a bin and each bin keeps
its smallest hash.  An empty bin borrows from a full one that it finds by its own fixed
sequence of bins (optimal densification).  A fingerprint packs the low bits of all bins, and
likeness corrects the share of equal bins for those equal by chance.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.carry import as_text, restored, whole_numbers
from gitstrata.llm.jaccard import hashed, mix

WORDS = 5
BINS = 512  # a power of two
BITS = 4  # low bits kept of every bin
SEED = 13

U = np.uint64


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A hash of every run of ``words`` words, repeats included; a shorter text is one run."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    n = min(words, len(parts))
    h = hashed(parts)
    out = np.full(len(h) - n + 1, U(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * U(0x9E3779B97F4A7C15) + h[j:j + len(out)]
    return mix(out)


@functools.cache
def sequences(bins: int) -> np.ndarray:
    """For every bin the order in which it asks all bins, drawn once and the same in every task."""
    rng = np.random.default_rng([SEED, bins])
    return np.argsort(rng.random((bins, bins)), axis=1)


@functools.cache
def marks(bins: int) -> np.ndarray:
    """A word per bin, mixed into its value: where one shingle fills many bins, their low bits don't agree by one chance."""
    return mix(np.arange(1, bins + 1, dtype=np.uint64))


def densified(smallest: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Values of all bins: an empty one takes that of the first full bin of its sequence."""
    empty = np.flatnonzero(~full)
    if not len(empty) or len(empty) == len(full):
        return smallest
    order, out = sequences(len(full)), smallest.copy()
    out[empty] = smallest[order[empty, full[order[empty]].argmax(axis=1)]]
    return out


def bits_of(text: str, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The low bits of every bin, or None for a text without words."""
    h = np.sort(shingle_hashes(text, words))
    if not len(h):
        return None
    shift = U(64 - bins.bit_length() + 1)
    starts = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << shift)
    at = np.minimum(starts, len(h) - 1)
    full = (starts < len(h)) & ((h[at] >> shift) == np.arange(bins, dtype=np.uint64))
    return (mix(densified(h[at], full) ^ marks(bins)) & U(2**bits - 1)).astype(np.uint8)


def packed(values: np.ndarray | None, bits: int = BITS) -> bytes:
    """The bins side by side, ``bits`` each; empty for a text without words.  A fingerprint is this in hexadecimal."""
    if values is None:
        return b""
    wide = np.unpackbits(values[:, None], axis=1)[:, 8 - bits:]
    return np.packbits(wide.ravel()).tobytes()


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray | None:
    if not fingerprint:
        return None
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).reshape(-1, bits)
    return np.packbits(np.pad(flat, ((0, 0), (8 - bits, 0))), axis=1).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: equal bins less those that low bits make equal by chance."""
    if a is None or b is None:
        return 1.0 if a is None and b is None else 0.0
    chance = 0.5**bits
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / len(a) - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


class Described:
    """A document's place, text and own fingerprint, made once and used for itself and the one before."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text, self.bits = doc_id, text, bits_of(text)

    def row(self, following: Described) -> tuple:
        changed = edited(self.text, following.text)
        bits = self.bits if changed == self.text else bits_of(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        return (
            self.doc_id, len(self.text), digest, packed(self.bits), packed(bits),
            likeness(self.bits, bits), likeness(self.bits, following.bits),
        )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
EDGE = ["part", "first", "text"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document's text and of its edited text, with their likeness.

    A null text counts as empty.  The next document is the one with the next larger doc_id
    (null ids come first, rows of one doc_id are ordered by a hash of their text, equal rows
    by their place in the input); the last one's next is the first.  A text without words has
    an empty fingerprint, alike (1) to another such text alone.  A text of fewer than five
    words is one shingle.  An only row is its own next; an empty table gives no rows; other
    columns are ignored.

    Texts are dealt out by ranges of doc_id once.  Inside a range the next row is at hand; the
    first and the last row of every range, two rows a task, meet in a second small step.
    """
    types = whole_numbers(docs, ["doc_id"])
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("pos")
    )
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("pos")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sent = as_text(placed.select("doc_id", "text", F.spark_partition_id().alias("part")), ["doc_id"])
    kind = sent.schema["doc_id"].dataType.simpleString()
    values = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part = None, 0
        for batch in batches:
            out = []
            for doc, text, part in batch[["doc_id", "text", "part"]].itertuples(index=False):  # noqa: B007
                now = Described(doc, text)
                out.append(((*last.row(now), None, None, None)) if last else (doc, *[None] * (len(COLUMNS) - 1), part, True, text))
                last = now
            yield pd.DataFrame(out, columns=COLUMNS + EDGE)
        if last:
            yield pd.DataFrame([(last.doc_id, *[None] * (len(COLUMNS) - 1), part, False, last.text)], columns=COLUMNS + EDGE)

    walked = cut(sent.mapInPandas(walk, f"{values}, part int, first boolean, text string"))
    parts = sorted(r.part for r in walked.where("first").select("part").collect())
    done = walked.where("part is null").select(*COLUMNS)
    shown = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    if not parts:
        return restored(done, types).withColumns(shown)
    follows = F.create_map(*[F.lit(x) for a, b in zip(parts, parts[1:] + parts[:1], strict=True) for x in (a, b)])
    ends = walked.where("not first").select(follows[F.col("part")].alias("meet"), F.lit(0).alias("side"), "doc_id", "text")
    starts = walked.where("first").select(F.col("part").alias("meet"), F.lit(1).alias("side"), "doc_id", "text")

    def meet(two: pd.DataFrame) -> pd.DataFrame:
        a, b = two.sort_values("side")[["doc_id", "text"]].itertuples(index=False)
        return pd.DataFrame([Described(*a).row(Described(*b))], columns=COLUMNS)

    edges = ends.union(starts).groupBy("meet").applyInPandas(meet, values)
    return restored(done.union(edges), types).withColumns(shown)


def near(a: str, b: str, bits: int = BITS) -> float:
    """Likeness of two stored fingerprints."""
    return likeness(unpacked(a, bits), unpacked(b, bits), bits)


def fold(text: str | None) -> str:
    """Fingerprint of one text."""
    return packed(bits_of(text or "")).hex()
