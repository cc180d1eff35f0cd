"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the ball hashing of simhash.py (fingerprints within two bits) and, for all that it can't reach, from banded MinHash: 40 bands of 6 rows miss a pair at 0.8 with a chance of 5e-6, nearer pairs less. Each candidate
is verified by its shingles themselves, as bytes. Only components matter, so a band's group first links its members to its least one, in proportion to its size. Groups that this leaves in several components are searched for links between
these: the members outside a group's main component are held against all of it, where that is at most GROUP pairs (so at most 512 for each member); the members of other groups are dealt once more by 160 bands of 12 rows, and what is then still
apart within one group is searched like that, whatever its size. Pairs are first held against each other by sketches, a bit of each of 1920 least hashes: a group of many texts that are alike, but not by 0.8, makes few pairs whose texts have to
meet. Sketches pass over a pair at 0.8 with a chance of 7e-7.

Words are parted at white space, without the case of A-Z, as for the fingerprint. Texts of fewer than five words are one shingle; null, empty and blank texts are alike. Texts with the same words are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .anchors import mixed
from .common import small_batches, stored

SHINGLE, SIMILAR = 5, 0.8
#: Rows and bands of the search, and of the second one in large groups.
LEVELS = ((6, 40), (12, 160))
#: Bits of a sketch, and how many may differ: at 0.8 a tenth of them do, by chance.
BITS, DIFFER = 1920, 258
#: Up to so many pairs a group is searched by sketches at once: a pair takes some 50 ns, a member's sketch and 160 finer keys far more.
GROUP = 1 << 18


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[bytes]:
    words = _words(text)
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _least(grams: set[bytes], count: int) -> np.ndarray:
    """The least hash of the grams by each of so many functions."""
    hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
    factors = mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    least, step = np.full(count, 2**64 - 1, np.uint64), max(1, (1 << 18) // count)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), step):
            x = hashes[at : at + step, None] * factors
            np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    return least


def _keys(least: np.ndarray, rows: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(count, dtype=np.uint64) + np.uint64(rows << 32)
        for own in least.reshape(count, rows).T:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + own)
    return keys.view(np.int64)


def bands(grams: set[bytes], rows: int, count: int) -> np.ndarray:
    """A key for each band."""
    return _keys(_least(grams, rows * count), rows, count)


def sketch(least: np.ndarray) -> np.ndarray:
    """A bit of each of the first BITS least hashes."""
    with np.errstate(over="ignore"):
        return np.packbits((mixed(least[:BITS]) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _node(text: str | None) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(_words(text)))).view(np.int64))


def _nodes(texts: pd.Series) -> pd.Series:
    return pd.Series([_node(t) for t in texts], dtype="int64")


def _described(texts: pd.Series) -> pd.DataFrame:
    rows = [(_node(t), simhash.fingerprint(t), bands(shingles(t), *LEVELS[0])) for t in texts]
    return pd.DataFrame(rows, columns=["node", "fp", "bands"])


def _finer(texts: pd.Series) -> pd.DataFrame:
    rows, count = LEVELS[1]
    least = [_least(shingles(t), rows * count) for t in texts]
    return pd.DataFrame([(_keys(x, rows, count), sketch(x)) for x in least], columns=["keys", "sketch"])


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(shingles(x), shingles(y)) >= SIMILAR for x, y in zip(a, b)], dtype=bool)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as a shuffle has: few files would make large tasks of what their rows are exploded to."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _stars(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node): the pairs of each key's least node and its others; and the rows of keys with three nodes or more."""
    balls = stored(met.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "bands")
    more = stored(met.join(balls.where("n > 2").select("key", "a"), "key"), "members")
    return balls.where("n = 2").select("a", "b").union(more.select("a", F.col("node").alias("b"))).where("a <> b").distinct(), more


def _balls(groups: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or linked by ball hashing: each fingerprint's least node, and its others."""
    least = stored(groups.groupBy("fp").agg(F.min("node").alias("a")), "prints")
    linked = simhash.links(_dealt(least.select("fp")))
    ends = linked.join(least.select(F.col("fp").alias("a"), F.col("a").alias("u")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("v")), "b")
    return groups.join(least, "fp").where("a <> node").select("a", F.col("node").alias("b")).union(ends.select(F.least("u", "v"), F.greatest("u", "v")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return stored(pairs.join(a, "a").join(b, "b").where(F.pandas_udf(_similar, "boolean")("x", "y")).select("a", "b"), "similar")


def _divided(rows: DataFrame) -> DataFrame:
    """The rows (key, node, root) of keys with several roots, with the root that most of the key's rows have (main) and the number of pairs in which the others meet all of the key (pairs)."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("n")).where("n > x.c")
    return rows.select("key", "node", "root").join(counts.select("key", F.col("x.root").alias("main"), F.expr("n * (n - x.c)").alias("pairs")), "key")


def _apart(more: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of more whose key has nodes of several components, divided by the nodes' roots."""
    roots = simhash.components(edges)
    rooted = stored(more.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    return stored(_divided(rooted), "apart")


def _bridges(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node, root): the pairs of each key's least node and its others of other roots; and the rows of keys with several roots. Keys whose nodes are linked already are left out before anything is joined."""
    met = _dealt(met, "key")  # once for both uses
    several = met.groupBy("key").agg(F.min("node").alias("a"), F.min_by("root", "node").alias("its"), F.min("root").alias("low"), F.max("root").alias("high"))
    more = stored(met.join(several.where("low <> high").drop("low", "high"), "key"), "bridges")
    return more.where("root <> its").select("a", F.col("node").alias("b")).distinct(), more.select("key", "node")


def _across(rows: DataFrame, finer: DataFrame) -> DataFrame:
    """Pairs of nodes with a common key, different roots and sketches that are near: those outside a key's main root meet all of the key. A pair may meet at many keys; the join gives it at the least of them alone."""
    rows = rows if "main" in rows.columns else _divided(rows)
    keys = stored(rows.groupBy("node").agg(F.collect_set("key").alias("keys")).join(finer.select("node", "sketch"), "node"), "sketches")
    rows = rows.join(keys, "node").select("key", "node", "root", "main", "sketch", "keys")
    a, b = rows.where("root <> main").alias("a"), rows.alias("b")
    differ = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(BITS // 64)), F.lit(0))
    first = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    met = a.join(b, F.col("a.key") == F.col("b.key")).where(once & (F.col("a.root") != F.col("b.root")) & (differ <= DIFFER) & first)
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def components(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a near copy, but the roots. groups: node, fp and bands of each distinct node."""
    stars, more = _stars(_dealt(groups.select("node", "bands")).select("node", F.explode("bands").alias("key")))
    pairs = stored(stars.union(_balls(groups.select("node", "fp"))).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select(F.pandas_udf(_nodes, "long")("text").alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts.join(asked, "node", "left_semi"), "texts")
    edges = _verified(pairs, texts)
    apart = _apart(more, edges)
    if not apart.isEmpty():
        finer = texts.join(apart.select("node").distinct(), "node").select("node", F.pandas_udf(_finer, "struct<keys:array<long>,sketch:array<long>>")("text").alias("x"))
        finer = stored(finer.select("node", "x.*"), "finer")
        edges = edges.union(_verified(_across(apart.where(F.col("pairs") <= GROUP), finer), texts))
        large = stored(apart.where(F.col("pairs") > GROUP).select("node", "root").distinct(), "large")
        if not large.isEmpty():
            bridges, more = _bridges(large.join(finer, "node").select("node", "root", F.explode("keys").alias("key")))
            edges = edges.union(_verified(bridges, texts))
            edges = edges.union(_verified(_across(_apart(more, edges), finer), texts))
    return simhash.components(edges)


def rooted_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and node of each document; and node, low (the least id that has it) and root (the component's least node) of each distinct node."""
    small_batches(docs.sparkSession, 250)
    prints = stored(docs.select("doc_id", F.pandas_udf(_described, "struct<node:long,fp:long,bands:array<long>>")("text").alias("x")).select("doc_id", "x.*"), "described")
    groups = stored(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(docs, groups)
    return prints.select("doc_id", "node"), stored(groups.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "rooted")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of each document."""
    prints, rooted = rooted_nodes(docs)
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = stored(rooted.join(lows, "root").select("node", "component_id"), "named")
    return prints.join(named, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: one with its least id (rows without an id come last; of several texts with that id one whose node is least). Rows that share an id but not a component are judged apart."""
    _, rooted = rooted_nodes(docs)
    marked = docs.withColumn("__key", F.pandas_udf(_nodes, "long")("text"))
    return simhash.one_of_each(marked, rooted.withColumnRenamed("node", "key")).select(*docs.columns)
