"""Document fingerprints by one-permutation MinHash, and how like two of them are.

Each five-word shingle is hashed once. The hash's high bits name a bin and each bin keeps its least hash; an empty bin takes the value of the first filled one among bins that a hash of its own number draws (optimal densification). Of
each value the low BITS bits are stored, packed. Values that differ agree in these bits with a chance of 2^-BITS, so the share of equal values is corrected by it to give the likeness, an estimate of the Jaccard similarity of the two
sets of shingles; with 256 bins its standard error is at most 0.035.

Words are parted at white space, without the case of A-Z. A text of fewer than five words is one shingle; null, empty and blank texts are alike, with one shingle of no words. Equal texts have equal fingerprints and likeness 1. Texts are
hashed in blocks of BLOCK bytes, whatever their length.

A document's edited text is its own with the last quarter replaced by as many first code points of the next document in the order of ids (all, if it is shorter; after the last document: the first). Rows without an id come last; rows that
share an id come in the order of their texts' hashes. Equal rows follow each other in any order. A table of one row follows itself; an empty one gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import mixed
from .common import small_batches, stored, whole_text

SHINGLE, BINS, BITS = 5, 256, 4
BLOCK, DRAWS = 1 << 20, 32
EMPTY = np.uint64(2**64 - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _word_hashes(data: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            cut = _SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield np.array([xxhash.xxh64_intdigest(w) for w in data[at:end].lower().split()], np.uint64)
        at = end


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of so many words."""
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(h)


@cache
def _draws(block: int) -> np.ndarray:
    """The bins that each bin draws, in the block's DRAWS tries."""
    tries = np.arange(block * DRAWS, (block + 1) * DRAWS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mixed(tries + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def densified(least: np.ndarray) -> np.ndarray:
    """least with its empty bins filled; at least one is not."""
    filled, empty, out, block = least != EMPTY, np.flatnonzero(least == EMPTY), least.copy(), 0
    if filled.sum() == 1:
        return np.full(BINS, least[filled][0])
    while len(empty):
        drawn = _draws(block)[:, empty]
        hit = filled[drawn]
        found = hit.any(0)
        out[empty[found]] = least[drawn[hit.argmax(0)[found], np.flatnonzero(found)]]
        empty, block = empty[~found], block + 1
    return out


def fingerprint(text: str | None) -> bytes:
    least, before, some = np.full(BINS, EMPTY), np.empty(0, np.uint64), False
    for words in _word_hashes((text or "").encode()):
        words = np.concatenate([before, words])
        if len(words) >= SHINGLE:
            hashes = np.sort(_shingle_hashes(words, SHINGLE))
            bins = (hashes >> _SHIFT).astype(np.int64)
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            least[bins[first]] = np.minimum(least[bins[first]], hashes[first])
            words, some = words[1 - SHINGLE :], True
        before = words
    if not some:
        own = _shingle_hashes(before, len(before)) if len(before) else mixed(np.zeros(1, np.uint64))
        least[int(own[0] >> _SHIFT)] = own[0]
    low = (densified(least) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, -BITS:]).tobytes()


def values(packed: bytes) -> np.ndarray:
    """The stored bits of each bin."""
    return np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(BINS, BITS)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1."""
    by_chance = 2.0**-BITS
    return max(0.0, (float((values(a) == values(b)).all(1).mean()) - by_chance) / (1 - by_chance))


def fingerprinted(docs: DataFrame) -> Column:
    """The fingerprint of docs' column text, as bytes."""
    small_batches(docs.sparkSession)
    return F.pandas_udf(lambda texts: pd.Series([fingerprint(t) for t in texts], dtype=object), "binary")(F.col("text"))


def edited(text: str, after: str) -> str:
    gone = len(text) // 4
    return text[: len(text) - gone] + after[:gone]


def _compared(text: str, own: bytes, after: str, its: bytes) -> tuple:
    new = edited(text, after)
    print_ = fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, each compared with the next. The first and the last are given with their texts (end: 1 and 2), to be joined with the neighbouring partitions."""
    part, before, kind = TaskContext.get().partitionId(), None, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), kind, pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        columns = zip(*rows) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "end", "doc_id", "text", *_COLUMNS])

    for batch in batches:
        kind, out = batch["doc_id"].type, []
        for id_, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            own = fingerprint(text)
            if before:
                out.append((part, 0, before[0], None, *_compared(*before[1:], text, own)))
            else:
                out.append((part, 1, id_, text, None, None, own, None, None, None))
            before = id_, text, own
        yield packed(out)
    if before:
        yield packed([(part, 2, before[0], before[1], None, None, before[2], None, None, None)])


def _across(text: pd.Series, own: pd.Series, after: pd.Series, its: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_compared(*x) for x in zip(text, own, after, its)], columns=_COLUMNS)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints (bytes) of the text and of its edited text, and the likeness of the first to the second and to the next document's."""
    spark = docs.sparkSession
    small_batches(spark, 250)
    place = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]  # the last parts what is equal
    names = [f"place{n}" for n in range(4)]
    texts = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", *(c.alias(n) for c, n in zip(place, names)))
    in_order = texts.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(in_order.mapInArrow(_followed, f"part int, end int, doc_id {kind}, text string, {_TYPES}"), "followed")
    # One number for each partition; texts stay on the executors.
    parts = sorted(r["part"] for r in found.where("end = 1").select("part").collect())
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    first = found.where("end = 1").select(F.col("part").alias("after"), F.col("text").alias("its_text"), F.col("fingerprint").alias("its"))
    last = found.where("end = 2").select("part", "doc_id", "text", "fingerprint").join(follow, "part").join(first, "after")
    seams = last.select("doc_id", F.pandas_udf(_across, _TYPES)("text", "fingerprint", "its_text", "its").alias("x")).select("doc_id", "x.*")
    return found.where("end = 0").select("doc_id", *_COLUMNS).union(seams)


def hexadecimal(packed: Column) -> Column:
    return F.lower(F.hex(packed))
