"""Fingerprints against plain one-permutation MinHash, likeness against exact similarity, the edited texts against a plain loop."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from studyperf.llm import fingerprints
from studyperf.llm.anchors import mixed
from studyperf.llm.nearcopies import shingles, similarity

MASK = 2**64 - 1


def plain(text):
    """Bin by bin, in Python's whole numbers."""
    one = lambda x: int(mixed(np.array([x & MASK], np.uint64))[0])
    words = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()]
    bins = {}
    for i in range(max(1, len(words) - 4)):
        part = words[i : i + 5]
        h = len(part)
        for w in part:
            h = h * 0x9E3779B97F4A7C15 + w
        h = one(h)
        bins[h >> 56] = min(bins.get(h >> 56, MASK), h)
    out = []
    for k in range(256):
        at, n = k, 0
        while at not in bins:
            at, n = one(n * 256 + k + 1) % 256, n + 1
        out.append(bins[at] & 15)
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2]))


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 5000, int(size))) for size in rng.integers(1, 900, n)]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a b c d", "a b c d e", "A B c d E f", *texts(6), "é漢😀 word " * 40])
def test_equals_plain_version(text):
    assert fingerprints.fingerprint(text) == plain(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(texts(5)) + " " + "x" * 5000
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert fingerprints.fingerprint(text) == whole


def test_likeness_is_near_the_similarity():
    off = []
    for text, other in zip(texts(200), texts(200, 4)):
        words = text.split() * 3
        for kept in (1.0, 0.9, 0.7, 0.4, 0.0):
            new = " ".join(words[: int(kept * len(words))]) + " " + other
            off.append(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(new)) - similarity(shingles(text), shingles(new)))
    off = np.array(off)
    assert abs(off.mean()) < 0.004 and np.sqrt((off**2).mean()) < 0.035 and np.abs(off).max() < 0.16


def followed(rows):
    """What each row must have; ids are distinct."""
    own = sorted(((i is None, i or 0, i, t or "") for i, t in rows), key=lambda x: x[:2])
    out = {}
    for k, (*_, i, t) in enumerate(own):
        after = own[(k + 1) % len(own)][-1]
        n = len(t) // 4
        new = t[: len(t) - n] + after[:n]
        prints = [plain(x) for x in (t, new, after)]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1], fingerprints.likeness(*prints[:2]), fingerprints.likeness(prints[0], prints[2]))
    return out


def test_every_document_is_compared_with_the_next(spark):
    rows = [(int(i * 37 % 101), t) for i, t in enumerate(texts(60))] + [(None, "a text without an id " * 9), (500, None), (501, ""), (502, "é漢😀" * 50), (503, "one"), (504, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, text string, part string, end int, place0 string").repartition(7)
    for df in (docs, docs.where("doc_id = 504"), docs.where("doc_id > 502")):
        out = fingerprints.compared(df).collect()
        want = followed([(r["doc_id"], r["text"]) for r in df.collect()])
        assert len(out) == len(want) and {r["doc_id"]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in out} == want


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 40 + [(None, None)] * 3 + [(1, "other text")], "doc_id long, text string").repartition(5)
    out = fingerprints.compared(docs)
    assert out.count() == 44 and out.where("doc_id = 1 and n_chars = 15").select("fingerprint").distinct().count() == 1
    assert fingerprints.compared(docs.limit(0)).count() == 0
    assert docs.select(fingerprints.fingerprinted(docs).alias("p")).where(F.length("p") == 128).count() == 44
