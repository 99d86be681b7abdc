"""Repeated passages: anchored and whole paragraphs, MinHash bands, exact check, components.

An anchored paragraph is a run of words that starts at an anchor, a word pair with the
smallest hash of some window.  Where the same passage stands in two documents, the same
anchors are found in it whatever surrounds it, so paragraphs align without any layout.  It
is short, so few changed words part it; whole paragraphs (lines, blocks between blank lines,
short texts) are compared as they stand, and find near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.carry import as_text, restored, whole_numbers
from gitstrata.llm.graph import components
from gitstrata.llm.jaccard import hashed, mix
from gitstrata.llm.meetings import MEETING, arrange, whole_meetings
from gitstrata.llm.sized import settled, sized

LENGTH = 32  # words of a paragraph
WINDOW = 20  # an anchor in every so many words: a common run of LENGTH + WINDOW - 1 words holds a common paragraph
WORDS = 5  # words of a shingle
SIMILARITY = 0.8
RECALL = 0.95  # of pairs at SIMILARITY
CHUNK = 512  # paragraphs of one band value compared in one piece; larger groups piece by piece
HOLDERS = 200_000  # documents, each with the paragraphs asked of it, that are broadcast at most
ELEMENTS = 2_000_000  # shingles of pairs compared at once
CHARACTERS = 1 << 18  # of texts whose paragraphs are worked out at once
SHINGLES = LENGTH - WORDS + 1

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WHOLE = np.uint64(0xC2B2AE3D27D4EB4F)  # keeps hashes and keys of whole paragraphs apart


def tune(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 4) -> tuple[int, int]:
    """(bands, rows): the longest rows whose fewest bands reach ``recall``, within ``most`` hashes."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return most, 1


BANDS, ROWS = tune()
WHOLE_BANDS, WHOLE_ROWS = tune(most=6)  # no anchor in the key, so more rows; never fewer bands than BANDS


def layout(lines: list[int]) -> list[tuple[int, int]]:
    """(first word, words) of the whole paragraphs of a text, from the words of its lines.

    A text below LENGTH words is one; others have their lines, and blocks of several lines
    where blank lines part them.  With fewer than WORDS words there is no shingle to compare.
    """
    ends = np.cumsum(lines).tolist()
    if not ends or ends[-1] < LENGTH:
        return [(0, ends[-1])] if ends and ends[-1] >= WORDS else []
    found = [(e - n, n) for n, e in zip(lines, ends, strict=True)]
    filled = [i for i, n in enumerate(lines) if n]
    if filled[-1] - filled[0] + 1 > len(filled):
        first = filled[0]
        for i, then in zip(filled, [*filled[1:], -1], strict=True):
            if then != i + 1:
                found.append((ends[first] - lines[first], ends[i] - ends[first] + lines[first]))
                first = then
    return [(at, n) for at, n in dict.fromkeys(found) if n >= WORDS]


class Paragraphs:
    """First word, words, hash, band keys and shingles of the paragraphs of some texts.

    The words of all texts lie on end, so a step over them is one array operation; no run that
    spans two texts is ever read.  ``at`` counts from the first of these words, ``offsets`` says
    where each text's paragraphs begin: anchored ones, then whole ones.
    """

    def __init__(self, texts: list[str | None]) -> None:
        parts: list[bytes] = []
        firsts, sizes, whole, n_whole = [], [], [], []
        for text in texts:
            first, lines = len(parts), []
            for line in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
                words = line.split()
                parts += words
                lines.append(len(words))
            found = layout(lines)
            firsts.append(first)
            sizes.append(len(parts) - first)
            whole += [(first + at, n) for at, n in found]
            n_whole.append(len(found))
        self.first, size = np.asarray(firsts, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
        self.runs, self.pair = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        if len(parts) >= WORDS:
            h = hashed(parts)
            self.runs = np.full(len(h) - WORDS + 1, WORDS, dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.pair = mix(h[:-1] * _GOLD + h[1:])
                for j in range(WORDS):
                    self.runs *= _GOLD
                    self.runs += h[j:j + len(self.runs)]
                    self.runs ^= self.runs >> np.uint64(29)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.runs))))
        anchored, text_of = self._anchored(size)
        given = np.asarray(whole, dtype=np.int64).reshape(-1, 2)
        text_of = np.concatenate((text_of, np.repeat(np.arange(len(texts)), n_whole)))
        order = np.argsort(text_of, kind="stable")
        self.text = text_of[order]
        self.at = np.concatenate((anchored, given[:, 0]))[order]
        self.words = np.concatenate((np.full(len(anchored), LENGTH), given[:, 1]))[order]
        self.anchor = order < len(anchored)
        self.offsets = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def _anchored(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and their texts; a text of LENGTH words has one at least."""
        long = np.flatnonzero(size >= LENGTH)
        if not len(long):
            return np.zeros(0, dtype=np.int64), long
        views = np.maximum(size[long] - WINDOW, 1)
        of = np.repeat(long, views)
        start = self.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(views) - views, views)
        wide = min(WINDOW, LENGTH - 1)
        at = start + np.argmin(np.lib.stride_tricks.sliding_window_view(self.pair, wide)[start], axis=1)
        keep = self._new(at, of) & (at + LENGTH <= self.first[of] + size[of])
        at, of = at[keep], of[keep]
        bare = np.setdiff1d(long, of)
        order = np.argsort(np.concatenate((of, bare)), kind="stable")
        at, of = np.concatenate((at, self.first[bare]))[order], np.concatenate((of, bare))[order]
        keep = self._new(self.total[at + SHINGLES] - self.total[at], of)  # one anchor for a run of the same words
        return at[keep], of[keep]

    @staticmethod
    def _new(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])))

    def starts(self) -> np.ndarray:
        """First words, counted from each text's own first one."""
        return self.at - self.first[self.text]

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix(self.total[self.at + self.words - WORDS + 1] - self.total[self.at])
            return np.where(self.anchor, h, mix(h + _WHOLE))

    def keys(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per band one key per paragraph, and where each text's begin: minima of the band's rows, with the anchor of anchored ones.

        Without the anchor, paragraphs that overlap in one text would collide; copies share it.
        Bands beyond BANDS have whole paragraphs only.
        """
        anchored, whole = self.at[self.anchor], self.at[~self.anchor]
        ends = whole + self.words[~self.anchor] - WORDS + 1
        spans = np.stack((whole, ends), axis=1).ravel()
        fewer = np.searchsorted(self.text[~self.anchor], np.arange(len(self.offsets)))
        orders, made = {}, []

        def order(number: int) -> np.ndarray:
            if number not in orders:
                # One place more, so that a last end is a place too.
                orders[number] = np.append(mix(self.runs ^ np.uint64(1 + number) * _GOLD), np.uint64(0))
            return orders[number]

        with np.errstate(over="ignore"):
            for b in range(WHOLE_BANDS):
                rest = np.full(len(whole), _WHOLE + np.uint64(b))
                if len(whole):
                    for r in range(WHOLE_ROWS):
                        rest = mix(rest * _GOLD + np.minimum.reduceat(order(b * WHOLE_ROWS + r), spans)[::2])
                if b >= BANDS:
                    made.append((rest, fewer))
                    continue
                both = np.zeros(len(self.at), dtype=np.uint64)
                both[~self.anchor] = rest
                if len(anchored):
                    key = mix(self.pair[anchored] + np.uint64(b))
                    for r in range(ROWS):
                        lows = np.lib.stride_tricks.sliding_window_view(order(b * ROWS + r), SHINGLES)[anchored].min(axis=1)
                        key = mix(key * _GOLD + lows)
                    both[self.anchor] = key
                made.append((both, self.offsets))
        return made

    def shingles(self, which: np.ndarray) -> list[np.ndarray]:
        """Sorted 32-bit shingle fingerprints of the chosen paragraphs; of whole ones each once."""
        made = []
        for i in which:
            part = (mix(self.runs[self.at[i]:self.at[i] + self.words[i] - WORDS + 1]) >> np.uint64(32)).astype(np.uint32)
            made.append(np.sort(part) if self.anchor[i] else np.unique(part))
        return made


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts with some CHARACTERS in sum, or of one longer text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parted(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    at = offsets.tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def place(docs: DataFrame) -> DataFrame:
    """Per document: first words, words, hashes and band keys of its paragraphs."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for x, y in pieces(texts):
                p = Paragraphs(texts[x:y])
                yield batch.iloc[x:y][["doc_id", "text_hash"]].assign(
                    at=parted(p.starts().astype(np.int32), p.offsets), words=parted(p.words.astype(np.int32), p.offsets),
                    h=parted(p.hashes().view(np.int64), p.offsets),
                    **{f"k{b}": parted(key.view(np.int64), offsets) for b, (key, offsets) in enumerate(p.keys())},
                )

    numbers = whole_numbers(docs, ["doc_id"])
    rows = as_text(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ["doc_id"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = ", ".join(f"k{b} array<long>" for b in range(WHOLE_BANDS))
    return restored(rows.mapInPandas(cut_up, f"doc_id {kind}, text_hash long, at array<int>, words array<int>, h array<long>, {keys}"), numbers)


def linked(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (a, b) between hashes of different paragraphs that are similar enough."""
    each = None
    for b in range(WHOLE_BANDS):
        n = F.size(f"k{b}")
        mine = F.slice("h", F.size("h") - n + 1, n).alias("h")  # the last ones, where a band has no anchored paragraphs
        band = placed.select("text_hash", F.explode(F.arrays_zip(mine, F.col(f"k{b}").alias("key"))).alias("p")).select(
            "text_hash", F.col("p.h").alias("h"), F.col("p.key").alias("key")
        )
        each = band if each is None else each.union(band)
    # Copies of a paragraph meet nobody new: only values with different paragraphs go on.
    lows = each.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = settled(lows.where("low < high").select("key"))
    members = settled(each.join(shared, "key").groupBy("key", "h").agg(F.min("text_hash").alias("t")))
    # Every paragraph is read from one document that holds it; a document is asked for its own only.
    asked = sized(
        members.groupBy("h").agg(F.min("t").alias("t")).groupBy("t").agg(F.collect_list("h").alias("asked")), HOLDERS
    )

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()  # copies of a text have nothing to add
        for batch in batches:
            rows = batch[[t not in met and not met.add(t) for t in batch["t"]]]
            texts, asked = rows["text"].tolist(), rows["asked"].tolist()
            for x, y in pieces(texts):
                p = Paragraphs(texts[x:y])
                h = p.hashes().view(np.int64)
                _, which = np.unique(h, return_index=True)
                which = which[np.isin(h[which], np.concatenate(asked[x:y]))]
                yield pd.DataFrame({"h": h[which], "full": [s.tobytes() for s in p.shingles(which)]})

    texts = docs.select("text", F.xxhash64("text").alias("t")).join(asked, "t").select("t", "text", "asked")
    sets = texts.mapInPandas(expand, "h long, full binary").dropDuplicates(["h"])
    hot = sized(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(
        "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")
    ))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows[MEETING] != rows[MEETING].shift()).any(axis=1).to_numpy()
        group = np.cumsum(new)
        behind = np.bincount(group)[group] - (np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))) - 1
        h, part, cross = rows["h"].to_numpy(), rows["part"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()
        full = [np.frombuffer(f, dtype=np.uint32) for f in rows["full"]]
        sizes = np.asarray([len(f) for f in full])
        first, flat = np.cumsum(sizes) - sizes, _numbered(full)
        parity = _parity(full)
        label = np.arange(len(rows))
        step, here = 1, np.flatnonzero(behind >= 1)
        a, b = [], []
        while len(here):
            for at in np.array_split(here, max(1, len(here) // 20_000)):
                there = at + step
                both = sizes[at] + sizes[there]
                apart = np.bitwise_count(parity[at] ^ parity[there]).sum(axis=1)
                test = apart <= both * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
                test &= np.minimum(sizes[at], sizes[there]) >= SIMILARITY * np.maximum(sizes[at], sizes[there])
                test &= ~cross[at] | (part[at] != part[there])
                at, there, both = at[test], there[test], both[test]
                piece = np.cumsum(both) // ELEMENTS
                for k in np.unique(piece):
                    x, y = at[piece == k], there[piece == k]
                    common = _common(flat, first, sizes, x, y)
                    good = common >= SIMILARITY * (sizes[x] + sizes[y] - common)
                    a.append(x[good])
                    b.append(y[good])
            step += 1
            here = here[behind[here] >= step]
        if a:
            _flood(label, np.concatenate(a), np.concatenate(b))
        far = label != np.arange(len(rows))
        return pd.DataFrame({"a": h[far], "b": h[label[far]]}).drop_duplicates()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return whole_meetings(batches, meet)

    together = arrange(members.select("key", "h").join(sets, "h"), hot, "h")
    return together.mapInPandas(scan, "a long, b long").distinct()


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit parity sketches: two are at most as far apart as their sets."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place, times = np.unique(owner * 128 + (flat & np.uint32(127)), return_counts=True)
    place = place[times % 2 == 1]
    bits = np.zeros((len(sets), 2), dtype=np.uint64)
    np.bitwise_or.at(bits, (place // 128, place // 64 % 2), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def _common(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common shingles of row pairs: sort those of both, pair by pair, and count equal neighbours."""
    rows, pair = np.concatenate((x, y)), np.tile(np.arange(len(x)), 2)
    n = sizes[rows]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(pair, n).astype(np.uint64)
    both = np.sort((owner << np.uint64(38)) | flat[np.repeat(first[rows], n) + within])
    same = both[1:] == both[:-1]
    return np.bincount((both[1:][same] >> np.uint64(38)).astype(np.int64), minlength=len(x))


def _numbered(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles of all rows on end, the repeats inside a row told apart; anchored rows alone have some."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint32)
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[np.cumsum([0, *[len(s) for s in sets[:-1]]])] = True
    at = np.arange(len(flat))
    again = at - np.maximum.accumulate(np.where(new, at, 0))
    return (flat.astype(np.uint64) << np.uint64(6)) | again.astype(np.uint64)


def _flood(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give every row the smallest row it is linked to, over any number of links."""
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if (before == label).all():
            return


def repeats(docs: DataFrame) -> DataFrame:
    """Passages that stand in more than one document: doc_id, text_hash, start, n_words, class_id, first_doc_id, kept.

    Paragraphs that are equal or linked are a class; its first place by doc_id, text and word
    stays (kept), the others are repeats.  Overlapping paragraphs of one document with the
    same fate are one passage, named by its smallest class.  Places count words.  Null and
    empty texts, and texts below WORDS words, have no passages; rows equal in doc_id and text are one document.
    """
    placed = cut(place(docs))
    joined = settled(components(settled(linked(docs, placed)))).select(F.col("node").alias("h"), "component")
    each = placed.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "words", "h")).alias("p")).select(
        "doc_id", "text_hash", "p.at", "p.words", "p.h"
    )
    known = each.groupBy("h").agg(F.count("*").alias("times"))
    several = known.join(joined, "h", "left").where("times > 1 or component is not null").select(
        "h", F.coalesce("component", "h").alias("class_id")
    )
    found = settled(each.join(several, "h").select("doc_id", "text_hash", "at", "words", "class_id").distinct())
    spot = F.struct("doc_id", "text_hash", "at", (-F.col("words")).alias("less"))
    doc = F.struct("doc_id", "text_hash")
    firsts = found.groupBy("class_id").agg(
        F.min(spot).alias("first"), F.min(doc).alias("low"), F.max(doc).alias("high")
    ).where(~F.col("low").eqNullSafe(F.col("high")))
    # A line and its block may be one class: what overlaps the first place is kept with it.
    here = doc.eqNullSafe(F.struct("first.doc_id", "first.text_hash")) & (F.col("at") < F.col("first.at") - F.col("first.less"))
    marked = found.join(firsts, "class_id").select(
        "doc_id", "text_hash", "at", "words", "class_id", F.col("first.doc_id").alias("first_doc_id"), here.alias("kept")
    )
    ahead = Window.partitionBy("doc_id", "text_hash", "kept").orderBy("at")
    last = F.max(F.col("at") + F.col("words")).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    islands = marked.withColumn("new", F.when(F.col("at") <= last, 0).otherwise(1)).withColumn("island", F.sum("new").over(ahead))
    return islands.groupBy("doc_id", "text_hash", "kept", "island").agg(
        F.min("at").alias("start"), (F.max(F.col("at") + F.col("words")) - F.min("at")).alias("n_words"),
        F.min("class_id").alias("class_id"), F.min("first_doc_id").alias("first_doc_id"),
    ).select("doc_id", "text_hash", "start", "n_words", "class_id", "first_doc_id", "kept")
