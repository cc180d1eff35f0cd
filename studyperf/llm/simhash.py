"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint emits every variant within half the radius. Two fingerprints within the radius meet at a variant half way, and what meets there is within the radius.
A variant's ball holds few distinct fingerprints (65 for one bit), however many documents share them, so linking each to the least one in its ball keeps all components without
forming pairs, and no group is large: copies collapse to one fingerprint before anything is emitted. Links are deduplicated and verified, components found by alternating stars.

Null, empty and blank texts have the fingerprint zero and are linked like any other. Repeated rows share a fingerprint. component_id is the smallest doc_id reachable; null ids
belong to the component but never name it unless it has no others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, as a signed integer: each set if set in over half the hashes of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = b"".join([xxhash.xxh64_digest(g, seed) for g in grams])
    n, ones = len(hashes) // 8, np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 * BLOCK):
        part = np.frombuffer(hashes[at : at + 8 * BLOCK], np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t, shingle, seed) for t in part], dtype="int64")

    return prints(F.col("text"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within the radius, enough for all components; radius is even."""
    half = radius // 2
    masks = [_signed(sum(1 << b for b in bits)) for n in range(half + 1) for bits in combinations(range(64), n)]
    met = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = met.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    # A ball with two members gives their link at once. Larger ones are few: near copies; only their members are looked up again.
    least = stored(least.where("n > 1"), "balls")
    more = met.join(least.where("n > 2").select("variant", "a"), "variant").select("a", F.col("fp").alias("b"))
    return least.where("n = 2").select("a", "b").union(more).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of each node of the edges (a, b) but the roots: alternating large and small stars until nothing changes.

    Each round's tables are stored, so that the plan stays short and a large star's rows join with tables that Spark can split.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(most):
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        # large star: each node's larger neighbours go to its least one
        edges = stored(edges.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: each node and its smaller neighbours go to the least of them
        low = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"no end after {most} rounds")


def rooted_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, low (the least id that has it) and root (the component's least fp) of each distinct fp in prints (doc_id, fp)."""
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    roots = components(links(groups.select("fp"), radius))
    return stored(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed) and component_id of each document."""
    prints = stored(docs.select("doc_id", fingerprinted(docs, shingle, seed).alias("fp")), "prints")
    rooted = rooted_prints(prints, radius)
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = stored(rooted.join(lows, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component: one with its least id (rows without an id come last; of several texts with that id one whose fingerprint is least). Rows that share an id but not a component are judged apart."""
    marked = docs.withColumn("__key", fingerprinted(docs, shingle, seed))
    rooted = rooted_prints(stored(marked.select("doc_id", F.col("__key").alias("fp")), "prints"), radius)
    return one_of_each(marked, rooted.withColumnRenamed("fp", "key")).select(*docs.columns)


def one_of_each(marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of marked (documents with __key) one row of each component of rooted (key, low, root): that of the least low, then key. The texts are shuffled once: the join and what follows it are dealt by the same columns."""
    known = lambda c: (F.coalesce(c, F.lit(0)).alias("__id"), F.col(c).isNull().alias("__unnamed"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("unnamed"), "low", "key")).alias("x"))
    least = least.select(F.col("x.key").alias("__key"), *known("x.low"))
    own = ["__key", "__id", "__unnamed"]
    return marked.select("*", *known("doc_id")).join(least, own).dropDuplicates(own)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
