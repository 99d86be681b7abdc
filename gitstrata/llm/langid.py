"""Language identification by language-bitmask n-gram filters.

The filter is one table of bit masks: slot s holds a bit for every language that has an
n-gram hashed to s.  AND-ing the masks of an n-gram's slots is a Bloom lookup for all
languages at once.  A text's lookups are counted per language, the counts are corrected
for false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.carry import as_text, restored, whole_numbers

ORDERS = (3, 4)  # lengths of the character n-grams; a space stands for every run of non-letters
SAMPLE_PER_LANGUAGE = 3000  # expected labelled texts a language is learned from: the bound of the fit
RAREST = 1 / 20_000  # share of a language's n-grams that one must reach; so at most 20,000 per order
SLOTS = 1 << 20
PROBES = 2
UNDETERMINED = "und"
LETTERS_AT_ONCE = 1 << 19  # some 50 bytes of scratch each

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Letters:
    """Code points to lower-case letters; everything else becomes a space."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, 32, dtype=np.uint32)
        for start, stop in ((0, 0x3400), (0xA000, 0xD7A4), (0xF900, 0x10000)):
            for c in range(start, stop):
                if chr(c).isalpha():
                    low = chr(c).lower()
                    self.table[c] = ord(low) if len(low) == 1 else c
        for start, stop in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x323B0)):
            self.table[start:stop] = np.arange(start, stop)
        for c in range(0x10000, 0x20000):
            if chr(c).isalpha():
                self.table[c] = ord(chr(c).lower()[0])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all texts, words parted by one space, and each text's first place.

        Every text has a space of its own at both ends.  An n-gram over the border of two texts
        thus holds two spaces in a row, one of them inside it, and is no n-gram of either.
        """
        codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), dtype="<u4")
        sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(sizes) - sizes
        low = self.table[codes]
        keep = np.ones(len(low), dtype=bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
        keep[first] = True
        return low[keep], (np.cumsum(keep) - 1)[first]


def grams(low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place and whether it holds a letter but no inner word gap."""
    m = len(low) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    h = np.full(m, n, dtype=np.uint64)
    good = np.ones(m, dtype=bool)
    with np.errstate(over="ignore"):
        for j in range(n):
            part = low[j:j + m]
            h = (h ^ part.astype(np.uint64)) * _MIX[0]
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                good &= part != 32
    return h, good


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some LETTERS_AT_ONCE characters, so memory is bounded by one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= LETTERS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the slot table, from columns ``text`` and ``lang``.

    Different texts are counted over all rows; of a language with more than ``sample`` of them, a
    share is drawn by hash of the text.  Copies of a text and repeated rows count once; rows
    without text or label teach nothing, and a table without any gives no languages.  N-gram counts are summed before the shuffle, and those that reach
    ``RAREST`` of their language come to the driver: 1 / RAREST per language and order at most.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    different = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((1, SLOTS), dtype=np.uint64)
    limits = {k: int(min(1.0, sample / n) * 1_000_000) for k, n in sizes.items()}
    share = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("lang", "text").distinct()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for part in parts:
            for lang, rows in part.groupby("lang"):
                texts = rows["text"].tolist()
                for a, b in batches_of(texts):
                    low, _ = letters.of(texts[a:b])
                    for n in ORDERS:
                        h, good = grams(low, n)
                        key, times = np.unique(h[good], return_counts=True)
                        yield pd.DataFrame({"lang": lang, "n": n, "gram": key.view(np.int64), "times": times})

    counts = (
        drawn.mapInPandas(count, "lang string, n int, gram long, times long")
        .groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    ).persist()
    totals = counts.groupBy("lang", "n").agg((F.sum("times") * F.lit(RAREST)).alias("least"))
    frequent = counts.join(F.broadcast(totals), ["lang", "n"]).where("times >= least").select("lang", "gram").toPandas()
    counts.unpersist()
    table = np.zeros((1 + (len(names) - 1) // 64, SLOTS), dtype=np.uint64)
    place = {k: i for i, k in enumerate(names)}
    for lang, rows in frequent.groupby("lang"):
        i = place[lang]
        for slot in slots(rows["gram"].to_numpy(dtype=np.int64).view(np.uint64)):
            np.bitwise_or.at(table[i // 64], slot, np.uint64(1 << (i % 64)))
    return names, table


def slots(h: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((h * _MIX[p + 1]) >> np.uint64(44)).astype(np.int64) for p in range(PROBES)]


def predict(docs: DataFrame, names: list[str], table: np.ndarray, keep: list[Column]) -> DataFrame:
    """``keep`` columns, lang_pred, score and known (share of n-grams its language knows).

    A ``keep`` column named text is the text itself.
    Score is the winner's share of what the two best languages know: 1 with no rival, 0.5
    at a tie, which the first name wins.  A null text, one without letters, or a model
    without languages gives ``und`` and 0; letters no language knows give the first name and 0.
    A row's result depends on its text alone; every row, repeated or not, has one, and an
    empty table has none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)  # SLOTS x 8 bytes for each 64 languages
    fill = [((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES for i in range(len(names))]
    rows = docs.select(*keep)
    kept, body = rows.columns, "text"
    if body not in kept:  # a kept text goes to the workers once
        body = "text_in"
        rows = docs.select(*keep, F.col("text").alias(body))
    numbers = whole_numbers(rows, kept)
    rows = as_text(rows, kept)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(kept)])

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, masks = Letters(), shared.value
        for part in parts:
            texts = part[body].fillna("").tolist()
            for a, b in batches_of(texts):
                best, score, share = zip(*_decide(letters, masks, fill, texts[a:b]), strict=True)
                picked = [names[i] if i >= 0 else UNDETERMINED for i in best]
                yield part.iloc[a:b][kept].assign(lang_pred=picked, score=score, known=share)

    judged = rows.mapInPandas(decide, f"{types}, lang_pred string, score double, known double")
    return restored(judged, numbers)


def _decide(letters: Letters, masks: np.ndarray, fill: list[float], texts: list[str]):
    low, starts = letters.of(texts)
    some = np.add.reduceat(np.append(low != 32, False).astype(np.int64), starts)
    hits = np.zeros((len(fill), len(texts)))
    total = np.zeros(len(texts))
    for n in ORDERS:
        h, good = grams(low, n)
        if not len(h):
            continue
        first = np.minimum(starts, len(h))  # a text too short for an n-gram takes none of its neighbour's
        pad = np.append(good, False)
        total += np.add.reduceat(pad.astype(np.int32), first)
        at = slots(h)
        for word in range(masks.shape[0]):
            mask = masks[word][at[0]]
            for slot in at[1:]:
                mask &= masks[word][slot]
            mask[~good] = 0
            mask = np.append(mask, np.uint64(0))
            for i in range(64 * word, min(len(fill), 64 * word + 64)):
                hits[i] += np.add.reduceat(((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int32), first)
    rate = hits / np.maximum(total, 1)
    for i, f in enumerate(fill):
        rate[i] = np.clip((rate[i] - f) / max(1e-9, 1 - f), 0, 1)
    for d in range(len(texts)):
        if not fill or not some[d] or not texts[d]:
            yield -1, 0.0, 0.0
            continue
        order = np.argsort(-rate[:, d], kind="stable")
        best = float(rate[order[0], d])
        second = float(rate[order[1], d]) if len(fill) > 1 else 0.0
        yield int(order[0]), best / (best + second) if best > 0 else 0.0, best


def is_held_out() -> Column:
    """Documents never learned from; a null doc_id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known of every document, learned on those not held out."""
    names, table = learn(docs.where(~is_held_out()).select("text", "lang"))
    return predict(docs, names, table, [F.col("doc_id"), is_held_out().alias("held_out")])
