"""Hard-negative mining: for each anchor and positive, the highest-scored rows of other labels within a band below the positive's score.

Scores are integer inner products, exact: component matrices are multiplied in float32 modulo several small primes, and the residues joined by Chinese remaindering. A tile takes as many primes as its longest vectors need.

Anchors and rows meet in cells of a grid (a block of anchors, a block of rows). A cell's anchors come first and are held, at most ANCHORS of them; its rows stream past in batches and only each anchor's best few are kept, so memory is
bounded whatever the table. Windows over these few then choose the winners. Anchors are asked against all rows twice: for the positives, and with their scores for the negatives.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do rows whose squared length, in whole numbers, exceeds 2^55, since their scores could leave 64 bits. Vectors of unlike lengths are compared
over their common components; an empty one scores 0. Ties go to the smaller id. An anchor's other rows are those of another id: rows that share an id are rows of their own, but neither positives nor negatives of each other. An anchor without positives,
and a positive without rows in its band, gives no row. Columns other than the three named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LONGEST = float(1 << 55)
#: Anchors of one block, rows of one, and entries of a score matrix.
ANCHORS, ROWS, TILE = 1 << 13, 1 << 18, 1 << 20
LOW = np.iinfo(np.int64).min


def primes(below: int, count: int) -> list[int]:
    """The largest primes below a bound, in falling order."""
    return [n for n in range(below - 1, 1, -1) if all(n % d for d in range(2, int(n**0.5) + 1))][:count]


#: Seven of them exceed 2^62, twice any score and more.
MODULI = primes(512, 7)
#: A float32 sum of so many products of balanced residues is exact.
DEPTH = (1 << 24) // (MODULI[0] // 2) ** 2


def needed(bound: float) -> list[int]:
    """Enough moduli to tell apart all integers from -bound to bound."""
    product, n = 1, 0
    while product <= 2 * bound + 1:
        product, n = product * MODULI[n], n + 1
    return MODULI[: max(n, 1)]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residues of least absolute value."""
    r = x % p
    return r - p * (r > p // 2)


def residues(m: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [balanced(m, p).astype(np.float32) for p in moduli]


def product(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The exact product of two integer matrices, the second transposed, given by their residues: mixed-radix digits, each from one float32 product."""
    total, radix = None, 1
    for p, x, y in zip(moduli, a, b):
        r = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, x.shape[1], DEPTH):
            r += (x[:, at : at + DEPTH] @ y[:, at : at + DEPTH].T).astype(np.int64)
        if total is None:
            total = balanced(r, p)
        else:
            total += radix * balanced((r - total) % p * pow(radix, -1, p), p)
        radix *= p
    return total


class Best:
    """The best k (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, LOW, np.int64)
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def offer(self, first: int, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores are slots from first on; columns are the rows named by ids."""
        masked, k, own = np.where(valid, scores, LOW), self.k, slice(first, first + len(scores))
        floor = self.floor[own]
        if masked.shape[1] > k:
            floor = np.maximum(floor, np.partition(masked, -k, axis=1)[:, -k])
        slot, col = np.nonzero(valid & (masked >= floor[:, None]))
        if not len(slot):
            return
        slots, score, id_ = (np.concatenate(x) for x in ((self.slot, slot + first), (self.score, masked[slot, col]), (self.id, ids[col])))
        order = np.lexsort((id_, -score, slots))
        slots, score, id_ = slots[order], score[order], id_[order]
        nth = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = nth < k
        self.slot, self.score, self.id = slots[kept], score[kept], id_[kept]
        full = nth == k - 1
        self.floor[slots[full]] = score[full]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Integer vectors as rows of a matrix, shorter ones filled with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
    out, flat = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64), np.asarray(vectors.flatten()).astype(np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def longest(m: np.ndarray) -> float:
    return float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0)))


class Cell:
    """A block of anchors, past which rows stream. places: 0 to look for positives, else the number of scores an anchor may bring."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, places: int, band: tuple[int, int]):
        whole = pa.Table.from_batches(batches).combine_chunks()
        self.m = matrix(whole["v"].combine_chunks())
        self.anchor, self.id, self.label = (whole[c].to_numpy() for c in ("anchor", "id", "label"))
        self.length, self.band, self.places, self.residues = longest(self.m), band, places, {}
        self.given = matrix(whole["scores"].combine_chunks()) if places else None
        self.count = np.diff(np.asarray(whole["scores"].combine_chunks().offsets)) if places else None
        self.best = [Best(len(self.anchor), k) for _ in range(max(1, places))]

    def meet(self, batch: pa.RecordBatch) -> None:
        rows, ids, label = matrix(batch["v"]), batch["id"].to_numpy(), batch["label"].to_numpy()
        width = min(rows.shape[1], self.m.shape[1])
        moduli = needed(self.length * longest(rows) * (1 + 1e-9) + 1)
        if (len(moduli), width) not in self.residues:
            self.residues = {(len(moduli), width): residues(self.m[:, :width], moduli)}
        own, theirs = self.residues[len(moduli), width], residues(rows[:, :width], moduli)
        step = max(1, TILE // max(1, len(rows)))
        for at in range(0, len(self.anchor), step):
            part = slice(at, at + step)
            scores = product([x[part] for x in own], theirs, moduli)
            alike, other = self.label[part, None] == label, self.id[part, None] != ids
            if not self.places:
                self.best[0].offer(at, scores, alike & other, ids)
                continue
            for place in range(min(self.places, self.given.shape[1])):
                top = self.given[part, place, None]
                valid = ~alike & other & (self.count[part, None] > place) & (scores <= top) & (self.band[1] * scores >= self.band[0] * top)
                self.best[place].offer(at, scores, valid, ids)

    def found(self) -> pa.RecordBatch:
        columns = [np.concatenate([self.anchor[b.slot] for b in self.best]), np.concatenate([np.full(len(b.slot), n + 1) for n, b in enumerate(self.best)])]
        columns += [np.concatenate([getattr(b, c) for b in self.best]) for c in ("score", "id")]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "place", "score", "other"])


def _searched(grid: DataFrame, k: int, places: int, band: tuple[int, int]) -> DataFrame:
    """The best k others of each anchor (and place), of each cell's rows. grid comes sorted by cell, anchors first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, cell = None, [], None
        for batch in batches:
            numbers, is_anchor = batch["cell"].to_numpy(), batch["anchor"].is_valid().to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(np.diff(numbers) | np.diff(is_anchor.astype(int))) + 1, batch.num_rows]
            for a, z in zip([0, *ends], ends):
                if z == a:
                    continue
                if numbers[a] != at:
                    if cell:
                        yield cell.found()
                    at, block, cell = numbers[a], [], None
                if is_anchor[a]:
                    block.append(batch.slice(a, z - a))
                elif block:
                    cell = cell or Cell(block, k, places, band)
                    cell.meet(batch.slice(a, z - a))
        if cell:
            yield cell.found()

    return grid.mapInArrow(search, "anchor long, place long, score long, other long")


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Each row in one cell for every block of anchors, each anchor in one for every block of rows. Blocks are dealt by the place in the table, so equal rows spread."""
    down = max(1, -(-n_anchors // ANCHORS))
    along = max(-(-n_rows // ROWS), rows.sparkSession.sparkContext.defaultParallelism // down, 1)
    to_rows = anchors.withColumn("cell", F.explode(F.sequence(F.pmod("anchor", F.lit(down)) * along, F.pmod("anchor", F.lit(down)) * along + along - 1)))
    block = F.pmod(F.monotonically_increasing_id(), F.lit(along))
    to_anchors = rows.withColumn("block", block).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda j: j * along + F.col("block")))).drop("block")
    both = to_rows.unionByName(to_anchors, allowMissingColumns=True).withColumn("cell", F.col("cell").cast("int"))
    return both.repartitionById(down * along, "cell").sortWithinPartitions("cell", F.col("anchor").isNull())


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, id_: Column, label: Column, vector: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: float = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. Components are taken as floor(scale * x); a negative's score lies between the positive's and band[0] / band[1] of it."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * F.lit(float(scale))) + 1, F.lit(2.0)))
    rows = vectors.where(id_.isNotNull() & label.isNotNull() & (length <= LONGEST)).select(id_.cast("long").alias("id"), label.cast("long").alias("label"), scaled.cast("array<int>").alias("v"), is_anchor.alias("is_anchor"))
    anchors = stored(rows.where("is_anchor").drop("is_anchor").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    rows, n_rows, n_anchors = rows.drop("is_anchor"), vectors.count(), anchors.count()

    best = _searched(_grid(rows, anchors, n_rows, n_anchors), positives, 0, band)
    best = stored(_first(best, positives, "anchor").select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id")), "positives")
    asked = anchors.join(best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores")), "anchor")
    found = _first(_searched(_grid(rows, asked, n_rows, n_anchors), negatives, positives, band), negatives, "anchor", "place")
    named = found.withColumn("place", F.col("place").cast("int")).join(best, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
