"""Repeated-phrase removal with Aho-Corasick automata.

Removed is each word covered by a window of WINDOW words that also starts earlier: in a document with a smaller id, or earlier in the same one. Anchors (see anchors.py) say which pieces of documents can hold recurring passages,
and bring pieces that can share one together. Each shard (a portion of the pieces' hashes, or keys) confirms, on the words themselves, which passages of its pieces recur, compiles them into an automaton over its own numbering of words, and streams
its pieces through it. What the automaton locates, and only that, is removed, but for each passage's first place. Documents are streamed in pieces, each to the one shard that can hold its passages, and not to all shards; pieces of
documents that no anchor marks can hold none.

Null texts have no words. A null id counts as larger than all others. Equal rows are one document; rows that share an id, or have none, and differ in text are documents of their own (anchors.keyed). Texts of fewer than WINDOW words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import doc_ids

WINDOW, GRAM = 20, 8
#: Bytes of a word that are hashed one by one; pieces in a shard, of which passages make an automaton.
LONG, SHARD = 64, 10_000


def _units(parts: list[list[bytes]]) -> np.ndarray:
    """A hash for each word: of its bytes, from the prefix sums of all words joined; long words stand by a digest."""
    words = list(chain.from_iterable(parts))
    if not words:
        return np.zeros(0, np.uint64)
    data, ends = _joined(words)
    if (np.diff(ends, prepend=-1) > LONG + 1).any():
        data, ends = _joined([w if len(w) <= LONG else xxhash.xxh64_hexdigest(w).encode() for w in words])
    start = np.append(0, ends[:-1] + 1)
    return anchors.mixed(anchors.Prefixes(data.astype(np.uint64) + np.uint64(1)).of(start, ends - start))


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, a space after each but the last, and where each ends. No word holds a space."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return data, np.append(np.flatnonzero(data == 32), len(data))


class Shard:
    """Confirms the passages of distinct texts that recur, and locates them. times: how often each text stands among the pieces."""

    def __init__(self, texts: list[bytes], times: list[int], windows: bool):
        numbers: dict[bytes, int] = {}
        self.rows = [tuple([numbers.setdefault(w, len(numbers)) for w in text.split()]) for text in texts]
        passages = {row for row, n in zip(self.rows, times) if n > 1}
        if windows:
            once: set[tuple[int, ...]] = set()
            for row in self.rows:
                for k in range(len(row) - WINDOW + 1):
                    window = row[k : k + WINDOW]
                    (passages if window in once else once).add(window)
        self.automaton = None
        if passages:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for number, passage in enumerate(passages):
                self.automaton.add_word(passage, (number, len(passage)))
            self.automaton.make_automaton()

    def hits(self) -> list[tuple[int, int, int, int]]:
        """Text, first window, number of windows and passage of each occurrence."""
        if self.automaton is None:
            return []
        return [(k, end + 1 - size, size - WINDOW + 1, number) for k, row in enumerate(self.rows) for end, (number, size) in self.automaton.iter(row)]


def _locate(group: np.ndarray, n: np.ndarray, data: list[bytes], windows: bool) -> tuple[np.ndarray, ...]:
    """Occurrences of the passages that recur in the pieces (see anchors.Locate). Pieces with the same text are streamed once. Shards are cut between groups."""
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(text, len(numbers)) for text in data], np.int64)
    times, texts = np.bincount(own).tolist(), list(numbers)
    lead = np.zeros(len(texts), np.int64)
    lead[own] = group
    order = np.argsort(lead, kind="stable")
    heads = np.flatnonzero(np.append(True, lead[order][1:] != lead[order][:-1]))
    shard = heads // SHARD
    found, passages = [], 0
    for rows in np.split(order, heads[np.flatnonzero(shard[1:] != shard[:-1]) + 1]):
        hits = np.array(Shard([texts[k] for k in rows], [times[k] for k in rows], windows).hits(), np.int64).reshape(-1, 4)
        if len(hits):
            hits[:, 0] = rows[hits[:, 0]]
            hits[:, 3] += passages
            passages = hits[:, 3].max() + 1
            found.append(hits)
    text, at, size, passage = (np.concatenate(found) if found else np.zeros((0, 4), np.int64)).T
    # from texts to the pieces that have them
    pieces = np.argsort(own, kind="stable")
    begin, count = np.searchsorted(own[pieces], text), np.array(times, np.int64)[text]
    each = np.repeat(np.arange(len(text)), count)
    return pieces[begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)], at[each], size[each], passage[each]


KIND = anchors.Kind(WINDOW, GRAM, bytes.split, _units, b" ".join, _locate, within=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by a space) of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, packs in zip(batch["text"], batch["spans"]):
                words, at, kept = (text or "").encode().split(), 0, []
                spans = anchors.merged(packs)
                for first, past in spans.tolist():
                    kept += words[at:first]
                    at = past
                kept += words[at:]
                rows.append((len(words), int((spans[:, 1] - spans[:, 0]).sum()), b" ".join(kept).decode()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "doc_id", doc_ids(batch))
            yield out

    return anchors.covered(docs, KIND).mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
