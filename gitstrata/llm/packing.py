"""Bounded-space best-fit packing of token sequences."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.scale import cut
from gitstrata.llm.carry import as_text, restored, whole_numbers

CAPACITY = 2048
OPEN_BINS = 16384  # bins a packer keeps open; more memory, not more tasks, when raised
PIECES_PER_TASK = 200_000  # pieces one packer sees; the last open bins of a packer are its only loss
SEPARATOR = 0  # id after each document
REMEMBERED = 500_000  # words whose ids a worker keeps


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Ids(dict):
    """Word (with the space before it) to its ids as bytes, encoded once.

    A space between two visible characters always starts a new part of the byte-level
    pattern, so encoding word by word gives the ids of the whole text.
    """

    edge = re.compile(r"(?<=\S) (?=\S)")
    odd = re.compile(r"^ | $| \s|\s ")
    # Fixed value: the public byte-level pattern.
    parts = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
        r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
    )

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary).model
        self.letters = byte_letters()
        self.part_ids: dict[str, bytes] = {}

    def of_part(self, part: str) -> bytes:
        found = self.part_ids.get(part)
        if found is None:
            shown = part.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) < 64:
                if len(self.part_ids) >= REMEMBERED:
                    self.part_ids.clear()
                self.part_ids[part] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.of_part, self.parts.findall(text)))

    def __missing__(self, word: str) -> bytes:
        found = self.of_part(f" {word}") if word.isalpha() else self.ids(f" {word}")
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        words = self.edge.split(text) if self.odd.search(text) else text.split(" ")
        return self.ids(words[0]) + b"".join(map(self.__getitem__, words[1:]))


@functools.cache
def known_ids(vocabulary: str) -> Ids:
    """One memory of words for all tasks of a worker."""
    return Ids(vocabulary)


class Packer:
    """Online best fit over a fixed number of open bins.

    Bit f of ``free`` is set while some open bin has f places left: the best fit for a
    piece of n is the lowest set bit from n up, found with two integer operations.  When
    all bins are open and none fits, the fullest one closes.
    """

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, bins
        self.free, self.open, self.made = 0, 0, 0
        self.slots: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, left: int) -> int:
        slot = self.slots[left]
        number = slot.pop()
        if not slot:
            self.free ^= 1 << left
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity``."""
        fits = self.free >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            number = self._take(left)
        else:
            left, number = self.capacity, self.made
            self.made += 1
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
        rest = left - length
        if rest:
            self.slots[rest].append(number)
            self.free |= 1 << rest
            self.open += 1
        return number, self.capacity - left


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids plus the separator, cut only where longer than ``capacity``.

    The first piece of a cut document is the short one.  A null or empty text is the
    separator alone; repeated and null ids are documents of their own.
    """
    path = vocabulary or default_vocabulary()
    end = np.asarray([SEPARATOR], dtype="<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = known_ids(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (known.encode(text) if text else b"") + end
                total = len(ids) // 4
                start, stop, k = 0, total % capacity or min(total, capacity), 0
                while start < total:
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop, k = stop, stop + capacity, k + 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame

    types = whole_numbers(docs, ["doc_id"])
    rows = as_text(docs.select("doc_id", "text"), ["doc_id"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut_up = rows.mapInPandas(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return restored(cut_up, types)


def pack(cut_pieces: DataFrame, tasks: int, capacity: int = CAPACITY, bins: int = OPEN_BINS) -> DataFrame:
    """The pieces with sequence_id and offset; longest pieces come first in each task."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, bins)
        for batch in batches:
            at = [packer.place(n) for n in batch["length"].tolist()]
            number, offset = np.asarray(at, dtype=np.int64).reshape(-1, 2).T
            first = batch["part"].to_numpy(dtype=np.int64) << 40
            yield batch.drop(columns="part").assign(sequence_id=first + number, offset=offset)

    types = whole_numbers(cut_pieces, ["doc_id"])
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    dealt = cut_pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(*order)
    rows = as_text(dealt, ["doc_id"]).withColumn("part", F.spark_partition_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    filled = rows.mapInPandas(
        fill, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return restored(filled, types)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens, one row per piece.

    Tokens are counted first (a narrow table), so that packers can be few and each sees
    many pieces: tasks grow with the number of pieces, and no text is shuffled.
    """
    counted = cut(pieces(docs, vocabulary, capacity))
    return pack(counted, max(1, -(-counted.count() // PIECES_PER_TASK)), capacity)
