"""Substring deduplication by a hash-compared suffix sort.

Removed is each byte covered by a string of WINDOW bytes that also starts in a document with a smaller id. Anchors (see anchors.py) say which pieces of documents can hold such strings, and bring pieces that can share one together;
there suffixes are sorted: those that begin a piece, up to its end, to find pieces that recur as wholes; where pieces of one key differ, those that begin a string of WINDOW bytes, up to its end. Two suffixes are compared by their
prefixes' polynomial hashes: binary search finds how far they agree, the next byte decides, so a comparison takes a logarithmic number of steps. Runs with equal hashes, or keys, and first eight bytes are sorted by merging. Neighbours
that the sort finds equal, and only these, are removed, but for the smallest document's; they are verified byte by byte, and if a hash should ever have lied, that task sorts by the bytes themselves.

Null texts are empty. A null id counts as larger than all others. Equal rows are one document; rows that share an id, or have none, and differ in text are documents of their own (anchors.keyed). Strings never cross documents. Short texts lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import doc_ids

WINDOW, GRAM = 50, 16
_BYTES = anchors.mixed(np.arange(1, 257, dtype=np.uint64))


def _units(parts: list[bytes]) -> np.ndarray:
    return _BYTES[np.frombuffer(b"".join(parts), np.uint8)]


def _words(data: bytes, at: int, order: str = "<") -> np.ndarray:
    """The eight bytes from each place + at, as a number; data ends with eight spare bytes or more."""
    return np.ndarray((len(data) - at - 7,), order + "u8", data, at, (1,))


class Suffixes:
    """Suffixes of a text, from places on and for sizes of bytes (eight at least), to be sorted within groups (equal ones are of one group)."""

    def __init__(self, data: bytes, places: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.data, self.places, self.sizes, self.groups = data + bytes(16), places, sizes, groups
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.prefixes = anchors.Prefixes(_BYTES[self.bytes])

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For how many bytes, up to the shorter one's size, the suffixes a and b agree: binary search over the prefixes' hashes."""
        high = np.minimum(self.sizes[a], self.sizes[b])
        low, p, q = np.zeros(len(a), np.int64), self.places[a], self.places[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefixes.of(p, mid) == self.prefixes.of(q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix a comes before b; of equal ones what ties says."""
        n, p, q = self.agree(a, b), self.sizes[a], self.sizes[b]
        ended = n >= np.minimum(p, q)
        return np.where(ended, (p < q) | ((p == q) & ties), self.bytes[self.places[a] + n] < self.bytes[self.places[b] + n])

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """An order of the suffixes, and for each in it the number of its class of equal ones."""
        head = _words(self.data, 0, ">")[self.places]
        order = np.lexsort((head, self.groups))
        head, group = head[order], self.groups[order]
        first = np.append(True, (head[1:] != head[:-1]) | (group[1:] != group[:-1]))[: len(order)]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        run = np.diff(np.append(np.flatnonzero(first), len(order)))
        size = np.repeat(run, run)
        width = 1
        while width < (run.max() if len(run) else 0):
            # merge neighbouring sorted blocks of each run: an element's new place is its own rank and the other block's smaller elements
            at = np.flatnonzero(size > width)
            inside = at - begin[at]
            block = inside // width
            other = np.minimum((block ^ 1) * width, size[at])
            length = np.minimum(other + width, size[at]) - other
            low, high = np.zeros(len(at), np.int64), length.copy()
            while (busy := np.flatnonzero(low < high)).size:
                mid = (low[busy] + high[busy]) >> 1
                theirs = order[begin[at[busy]] + other[busy] + mid]
                # of equal ones the left block's stand first
                less = self.before(theirs, order[at[busy]], (block[busy] & 1).astype(bool))
                low[busy] = np.where(less, mid + 1, low[busy])
                high[busy] = np.where(less, high[busy], mid)
            target = begin[at] + (block >> 1 << 1) * width + (inside - block * width) + low
            moved = order.copy()
            moved[target] = order[at]
            order = moved
            width *= 2
        a, b = order[:-1], order[1:]
        new = np.append(True, first[1:] | (self.sizes[a] != self.sizes[b]))[: len(order)]  # a merge keeps each run's places
        same = np.flatnonzero(~new)
        new[same] = self.agree(order[same - 1], order[same]) < self.sizes[order[same]]
        same = np.flatnonzero(~new)
        if not self.verified(order[same - 1], order[same]):  # a collision: the bytes themselves decide
            numbers: dict[bytes, int] = {}
            classes = np.array([numbers.setdefault(self.data[p : p + n], len(numbers)) for p, n in zip(self.places.tolist(), self.sizes.tolist())])
            order = np.argsort(classes, kind="stable")
            return order, classes[order]
        return order, np.cumsum(new) - 1

    def verified(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the suffixes a and b, of the same sizes, have the same bytes."""
        p, q, n, at = self.places[a], self.places[b], self.sizes[a], 0
        while len(p) and at < 512:
            step = np.minimum(at, n - 8)
            words = _words(self.data, 0)
            if (words[p + step] != words[q + step]).any():
                return False
            at += 8
            more = n > at
            p, q, n = p[more], q[more], n[more]
        return all(self.data[x : x + m] == self.data[y : y + m] for x, y, m in zip(p.tolist(), q.tolist(), n.tolist()))


def _locate(group: np.ndarray, n: np.ndarray, data: list[bytes], windows: bool) -> tuple[np.ndarray, ...]:
    """Pieces, or their windows, that the sort finds to be equal to another one (see anchors.Locate)."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    begin, text = np.cumsum(sizes) - sizes, b"".join(data)
    if not windows:
        piece, at = np.arange(len(data)), np.zeros(len(data), np.int64)
        order, classes = Suffixes(text, begin, sizes, group).sorted()
    else:
        piece = np.repeat(np.arange(len(data)), n)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        # suffixes whose window's hash stands alone have no equal
        hashes = anchors.Prefixes(_units(data)).of(begin[piece] + at, WINDOW)
        by = np.argsort(hashes)
        twin = np.append(False, hashes[by][1:] == hashes[by][:-1])[: len(by)]
        shared = by[twin | np.append(twin[1:], False)[: len(by)]]
        piece, at = piece[shared], at[shared]
        order, classes = Suffixes(text, begin[piece] + at, np.full(len(piece), WINDOW), group[piece]).sorted()
    several = np.bincount(classes, minlength=1)[classes] > 1
    order, classes = order[several], classes[several]
    return piece[order], at[order], np.ones(len(order), np.int64) if windows else n[order], classes


KIND = anchors.Kind(WINDOW, GRAM, bytes, _units, bytes, _locate, within=False)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (what remains, in bytes) of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, packs in zip(batch["text"], batch["spans"]):
                data, at, kept = (text or "").encode(), 0, []
                spans = anchors.merged(packs)
                for first, past in spans.tolist():
                    kept.append(data[at:first])
                    at = past
                kept.append(data[at:])
                rows.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(kept)))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", doc_ids(batch))
            yield out

    return anchors.covered(docs, KIND).mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
