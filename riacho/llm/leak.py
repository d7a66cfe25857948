"""Evaluation texts that leaked into a corpus, by an FM-index of every training shard.

Words (letters or digits, without case and accents) are the symbols. A shard's index covers only the stretches made of
words that evaluation items use and long enough for the shortest phrase: no other place can hold a phrase. All phrases
are searched backward at once through the ranks of a wavelet matrix; sampled suffix positions locate the hits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riacho.llm import pieces
from riacho.llm.suffix import suffix_array

#: Consecutive words that count as a leak.
LEAST_WORDS = 12
#: Items searched at once; more are taken in blocks.
BLOCK_ITEMS = 5_000
#: Characters of text per shard.
SHARD_CHARS = 12_000_000
SAMPLE = 8

_ACCENTS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFD", text)).casefold()
    else:
        text = text.lower()
    return _WORDS.findall(text)


class Phrases:
    """Phrases of evaluation items as rows of word numbers (right-aligned, padded with 0), and the items of each."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST_WORDS) -> None:
        self.vocabulary: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            n = min(least, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners[tuple(ids[i : i + n])].add(item)
        self.rows = np.zeros((len(owners), least), np.int32)
        self.sizes = np.fromiter(map(len, owners), np.int64, len(owners))
        for row, phrase in zip(self.rows, owners, strict=True):
            row[least - len(phrase) :] = phrase
        self.owners = list(owners.values())
        self.shortest = int(self.sizes.min()) if len(owners) else 0


class WaveletMatrix:
    """Ranks and symbols of an integer sequence, bit by bit from the highest."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        n = len(symbols)
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -n % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before))
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        packed, before = self.levels[level]
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before ``i``; element by element."""
        begin, end = np.zeros_like(i), i
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            b1, e1 = self._ones(level, begin), self._ones(level, end)
            begin = np.where(one, self.zeros[level] + b1, begin - b1)
            end = np.where(one, self.zeros[level] + e1, end - e1)
        return end - begin

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it occurs before."""
        c, begin, at = np.zeros_like(i), np.zeros_like(i), i
        for level in range(self.bits):
            before, upto = self._ones(level, at), self._ones(level, at + 1)
            one = upto > before
            b1 = self._ones(level, begin)
            begin = np.where(one, self.zeros[level] + b1, begin - b1)
            at = np.where(one, self.zeros[level] + before, at - before)
            c = c << 1 | one
        return c, at - begin


class FMIndex:
    """Count and locate phrases in a sequence whose 0 are separators (the last symbol must be one)."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])  # symbols smaller than c
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), top)
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.mark = np.concatenate([[0], np.cumsum(sampled)])
        self.kept = sa[sampled]

    def count(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [lo, hi) of each right-aligned phrase."""
        n = int(self.ends[-1])
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        live = np.arange(len(rows))
        for back in range(1, rows.shape[1] + 1):
            live = live[(sizes[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = rows[live, -back].astype(np.int64)
            lo[live] = self.ends[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.ends[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each suffix number."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walk = np.flatnonzero(self.mark[at + 1] == self.mark[at])
            if not len(walk):
                return self.kept[self.mark[at]] + steps
            c, before = self.wavelet.symbol_and_rank(at[walk])
            at[walk] = self.ends[c] + before
            steps[walk] += 1


def stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs without 0 of at least ``shortest`` symbols."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    keep = length >= shortest
    return start[keep], length[keep]


class Shard:
    """Collects the stretches of texts until they are searched together."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.chars = phrases, 0
        self.parts: list[np.ndarray] = []
        self.where: list[tuple[int, int, int]] = []  # start in the sequence, document, first word
        self.at = 0

    def add(self, doc: int, text: str) -> None:
        self.chars += len(text)
        get = self.phrases.vocabulary.get
        found = [get(w, 0) for w in words(text)]
        ids = np.array(found, np.int32)
        for s, n in zip(*(x.tolist() for x in stretches(ids, self.phrases.shortest)), strict=True):
            self.where.append((self.at, doc, s))
            self.parts += (ids[s : s + n], np.zeros(1, np.int32))
            self.at += n + 1

    def search(self) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, number of words) of every occurrence of every phrase."""
        if not self.where:
            return []
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.vocabulary))
        lo, hi = index.count(self.phrases.rows, self.phrases.sizes)
        hits = np.flatnonzero(hi > lo)
        number = np.repeat(hits, hi[hits] - lo[hits])
        suffix = np.concatenate([np.arange(a, b) for a, b in zip(lo[hits], hi[hits], strict=True)]) if len(hits) else hits
        position = index.locate(suffix)
        starts = np.array([w[0] for w in self.where])
        run = np.searchsorted(starts, position, "right") - 1
        out = []
        for p, r, k in zip(position.tolist(), run.tolist(), number.tolist(), strict=True):
            begin, doc, word = self.where[r]
            for item in self.phrases.owners[k]:
                out.append((doc, item, word + p - begin, int(self.phrases.sizes[k])))
        return out


def merged(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, number of words) with overlapping and touching spans of one item joined."""
    out: list[list[int]] = []
    for doc, item, at, n in sorted(set(hits)):
        if out and out[-1][:2] == [doc, item] and at <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], at + n - out[-1][2])
        else:
            out.append([doc, item, at, n])
    return [tuple(x) for x in out]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words): merged spans of each document that hold material of an item.

    A leak is ``least`` consecutive words of the item, or all of its words if it has fewer. Items without words and null
    or empty texts never match. Repeated rows of a document give repeated spans; words are counted from 0. Items are
    searched in blocks of ``block``, so their number is not limited by memory.
    """
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id bigint, first_word int, n_words int"
    rows = documents.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    batch: list[tuple[int, str]] = []

    def search(block_items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(block_items, least)
            shard, ids = Shard(phrases), []

            def flush() -> pa.RecordBatch:
                found = merged(shard.search())
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                arrays = [pa.array([ids[d] for d in columns[0]], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "first_word", "n_words"])

            kind = pa.int64()
            for piece, texts in pieces.slices(batches, "text"):
                kind = piece.column(0).type
                for doc, t in zip(piece.column(0).to_pylist(), texts, strict=True):
                    shard.add(len(ids), t or "")
                    ids.append(doc)
                if shard.chars >= SHARD_CHARS:
                    yield flush()
                    shard, ids = Shard(phrases), []
            yield flush()

        return rows.mapInArrow(run, schema)

    for r in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        batch.append((r[0], r[1]))
        if len(batch) == block:
            out = search(batch) if out is None else out.unionByName(search(batch))
            batch = []
    if batch or out is None:
        out = search(batch) if out is None else out.unionByName(search(batch))
    return out.withColumnRenamed("doc_id", doc_id)


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()
