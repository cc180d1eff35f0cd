"""Benchmark decontamination by SimHash of item-sized windows.

An item of n words is looked for in every window of n words; in a document of fewer words the whole of it is the window. Windows that share no five-word shingle with any item have similarity zero and are passed over; this drops nothing.
The others get a SimHash of their shingles, found in a multi-index: the 64 bits are cut into 8 blocks, and of two fingerprints that differ in at most RADIUS bits some block differs in at most RADIUS // 8. So looking up each block's
neighbours gives all fingerprints within the radius. Windows at a similarity of 0.8 differ in about 10 bits (a calculation: the angle of an eighth to a ninth of other shingles), with a spread of 3; the radius is four spreads above. It is
so wide that the blocks let most items of one length pass; what prunes is the shared shingle. Items that repeat a shingle, whose bits can differ more, are candidates without a look at their bits.
Candidates are verified by the exact weighted Jaccard similarity of their shingles (weight: how often).

Words are parted at white space, without case. Items of fewer than five words are one shingle of that size: found where these words stand one after the other. Null or blank items or texts match nothing. A document is reported once for each
item, with its best window (ties: the earliest). Items alike are each reported, repeated rows of the benchmark too, and repeated documents; an item without an id is reported with a null id. An empty benchmark finds nothing.

A benchmark above PART bytes is looked for in several passes over the documents, so that no worker ever holds more than one part's index (measured: 0.46 MB of items make an index of 31 MB).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

SHINGLE, SIMILAR, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Items are broadcast in parts of about so many bytes of text each, one pass over the documents for each.
PART = 2 << 20
HITS = "array<struct<item_id:long,start:int,similarity:double>>"
#: Odd numbers that mix a shingle's words.
MIX = np.array([xxhash.xxh64_intdigest(b"%d" % k) | 1 for k in range(SHINGLE)], np.uint64)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five, from the words' hashes."""
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        x = sum((words[k : k + n] ^ (words[k : k + n] >> np.uint64(29))) * MIX[k] for k in range(SHINGLE))
        return x ^ (x >> np.uint64(32))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


class Index:
    """A part of the benchmark: its shingles, and its fingerprints by length and block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, int, Counter, np.uint64]] = []
        shingles = []
        #: Items of fewer words than a shingle, by their words; of items that repeat a shingle the numbers, by their lengths.
        self.short: dict[tuple[str, ...], list[int | None]] = defaultdict(list)
        self.repeating: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            words = (text or "").lower().split()
            if 0 < len(words) < SHINGLE:
                self.short[tuple(words)].append(item)
            if len(words) >= SHINGLE:
                for word in words:
                    self.vocabulary.setdefault(word, _hash(word) or 1)
                own = _shingles(np.array([self.vocabulary[w] for w in words], np.uint64))
                ones = _bits(own).sum(0, dtype=np.int64)
                self.items.append((item, len(words), Counter(own.tolist()), np.packbits(2 * ones > len(own)).view(">u8")[0]))
                shingles.append(own)
        self.shingles = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.shingles >> np.uint64(44)] = True
        #: The lengths of the items that have a shingle.
        self.lengths: dict[int, set[int]] = defaultdict(set)
        #: By length, block and the block's value: items whose block is near.
        self.near: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        width = 64 // BLOCKS
        balls = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), n)]
        for at, (_, n, own, print_) in enumerate(self.items):
            for s in own:
                self.lengths[s].add(n)
            if max(own.values()) > 1:
                self.repeating[n].append(at)
            for block in range(BLOCKS):
                value = int(print_) >> width * block & (1 << width) - 1
                for mask in balls:
                    self.near[n, block, value ^ mask].append(at)

    def hits(self, text: str | None) -> list[tuple[int | None, int, float]]:
        words = (text or "").lower().split()
        out = [] if not self.short else self._short(words)
        best: dict[int, tuple[float, int]] = {}
        for n, places in self._places(words).items():
            for first, last in self._stretches(places, min(n, len(words)), len(words)):
                for at, start, similarity in self._within(words, first, last, n):
                    if at not in best or similarity > best[at][0]:
                        best[at] = similarity, start
        out += [(self.items[at][0], start, similarity) for at, (similarity, start) in best.items()]
        return sorted(out, key=lambda hit: (hit[0] is not None, hit[0] or 0, hit[1]))

    def _short(self, words: list[str]) -> list[tuple[int | None, int, float]]:
        first: dict[tuple[str, ...], int] = {}
        for n in sorted({len(item) for item in self.short}):
            for at, window in enumerate(zip(*(words[k:] for k in range(n)))):
                if window in self.short:
                    first.setdefault(window, at)
        return [(item, at, 1.0) for window, at in first.items() for item in self.short[window]]

    def _places(self, words: list[str]) -> dict[int, list[int]]:
        """For each length of items, the places of the text's shingles that such an item has."""
        by_length: dict[int, list[int]] = defaultdict(list)
        if len(words) < SHINGLE or not self.items:
            return by_length
        get = self.vocabulary.get
        x = _shingles(np.array([get(w, 0) for w in words], np.uint64))
        there = np.flatnonzero(self.seen[x >> np.uint64(44)])
        if len(there):
            at = np.minimum(np.searchsorted(self.shingles, x[there]), len(self.shingles) - 1)
            there = there[self.shingles[at] == x[there]]
        for i in there.tolist():
            for n in self.lengths[int(x[i])]:
                by_length[n].append(i)
        return by_length

    @staticmethod
    def _stretches(places: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
        """First and last starts of the windows of n words that hold one of the shingles."""
        first = last = None
        for i in places:
            a, b = max(0, i + SHINGLE - n), min(i, size - n)
            if a > b:
                continue
            if first is None:
                first, last = a, b
            elif a <= last + 1:
                last = max(last, b)
            else:
                yield first, last
                first, last = a, b
        if first is not None:
            yield first, last

    def _within(self, words: list[str], first: int, last: int, n: int) -> Iterator[tuple[int, int, float]]:
        """Verified (item, start, similarity) of the windows for items of n words that start at first to last."""
        size = min(n, len(words))
        m = size - SHINGLE + 1
        for begin in range(first, last + 1, 4096):
            end = min(last, begin + 4095)
            own = _shingles(np.array([self.vocabulary.get(w) or _hash(w) for w in words[begin : end + size]], np.uint64))
            sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(_bits(own), axis=0, dtype=np.int32)])
            prints = np.packbits(2 * (sums[m:] - sums[:-m]) > m, axis=1).view(">u8").ravel()
            for k, print_ in enumerate(prints.tolist()):
                close = {at for block in range(BLOCKS) for at in self.near.get((n, block, print_ >> 8 * block & 255), ()) if (print_ ^ int(self.items[at][3])).bit_count() <= RADIUS}
                for at in close.union(self.repeating.get(n, ())):
                    wanted = self.items[at][2]
                    common = sum((wanted & Counter(own[k : k + m].tolist())).values())
                    similarity = common / (m + n - SHINGLE + 1 - common)
                    if similarity >= SIMILAR:
                        yield at, begin + k, similarity


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART))
    for part in range(parts):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]


def _leaks(docs: DataFrame, items: list[tuple[int, str]]) -> Column:
    """For each document, the items of one part found in its text."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(HITS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value)
        for part in texts:
            yield pd.Series([[{"item_id": i, "start": s, "similarity": x} for i, s, x in index.hits(t)] for t in part], dtype=object)

    return found(F.col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (of the window, in words) and similarity: a row for each document and item found in it."""
    small_batches(docs.sparkSession)
    passes = [docs.select("doc_id", F.explode(_leaks(docs, items)).alias("hit")).select("doc_id", "hit.*") for items in _parts(benchmark)]
    return reduce(DataFrame.union, passes)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    small_batches(docs.sparkSession)
    columns, several = docs.columns, False
    for items in _parts(benchmark):
        docs = stored(docs, "clean") if several else docs
        docs, several = docs.withColumn("__leaks", _leaks(docs, items)).where(F.size("__leaks") == 0).select(*columns), True
    return docs
