"""Resharding by minimum-cost flow.

Rows lie in old shards; new capacities are given. A flow network has a node for each block of an old shard (its rows of like size) and one for each new shard; a row that stays costs nothing, one that moves costs its block's mean bytes. The
cheapest flow says how many rows of each block go where; it is solved on the blocks' counts alone, whose number is bounded by shards times size classes. Within a block rows are ranked by size, the
largest first, and those that stay take the first ranks. So only moved rows are rewritten: the smallest of the shards that have too many.

Law `rows`: new shards hold row counts at most one apart. Size: UTF-8 bytes plus 1 (null: 1). A null key counts as old shard 0. Equal rows are different rows and each gets its own slot. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

SHARDS = 16
#: Rows of a block are ranked in cells of about so many, for no task to sort a whole block.
CELL = 50_000


class Flow:
    """Successive cheapest paths (Dijkstra with potentials) on a small network."""

    def __init__(self):
        self.edges: list[list] = []  # to, capacity left, cost
        self.out: dict[object, list[int]] = defaultdict(list)

    def add(self, a, b, capacity: int, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def solve(self, source, sink) -> int:
        high: dict[object, float] = defaultdict(float)
        total = 0
        while True:
            far, via, heap, tick = {source: 0.0}, {}, [(0.0, 0, source)], 1
            while heap:
                d, _, node = heapq.heappop(heap)
                if d > far[node]:
                    continue
                for k in self.out[node]:
                    to, left, cost = self.edges[k]
                    if left and (new := d + max(0.0, cost + high[node] - high[to])) < far.get(to, float("inf")) - 1e-9:
                        far[to], via[to] = new, k
                        heapq.heappush(heap, (new, tick, to))
                        tick += 1
            if sink not in far:
                return total
            reach = max(far.values())
            for node in list(self.out):
                high[node] += far.get(node, reach)
            amount, node = None, sink
            while node != source:
                amount = min(x for x in (amount, self.edges[via[node]][1]) if x is not None)
                node = self.edges[via[node] ^ 1][0]
            node = sink
            while node != source:
                self.edges[via[node]][1] -= amount
                self.edges[via[node] ^ 1][1] += amount
                node = self.edges[via[node] ^ 1][0]
            total += amount


def transfers(blocks: dict[tuple[int, int], tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(old shard, size class, new shard, rows) of the cheapest flow. blocks: rows and bytes by old shard and size class. Capacities: counts at most one apart."""
    rows = sum(n for n, _ in blocks.values())
    least, extra = divmod(rows, shards)
    flow, arcs = Flow(), {}
    for (old, size), (n, total) in sorted(blocks.items()):
        block = "block", old, size
        flow.add("source", block, n, 0)
        arcs[old, size, old] = flow.add(block, ("new", old), n, 0) if old < shards else None
        arcs[old, size, -1] = flow.add(block, "moved", n, total / n)
    for new in range(shards):
        # all capacities together are the number of rows, so a flow of all rows fills each shard
        flow.add(("new", new), "sink", least, 0)
        flow.add(("new", new), "spare", 1, 0)
        arcs["moved", new] = flow.add("moved", ("new", new), least + 1, 0)
    flow.add("spare", "sink", extra, 0)
    if flow.solve("source", "sink") != rows:
        raise RuntimeError("the capacities don't hold all rows")
    used = lambda k: flow.edges[k ^ 1][1] if k is not None else 0
    out = [(old, size, old, used(arcs[old, size, old])) for old, size in sorted(blocks) if used(arcs[old, size, old])]
    wanted = [[new, used(arcs["moved", new])] for new in range(shards) if used(arcs["moved", new])]
    for old, size in sorted(blocks):
        left = used(arcs[old, size, -1])
        while left:
            n = min(left, wanted[0][1])
            out.append((old, size, wanted[0][0], n))
            left, wanted[0][1] = left - n, wanted[0][1] - n
            if not wanted[0][1]:
                wanted.pop(0)
    return out


def size_class(size: Column) -> Column:
    """Eight classes for each doubling; a bounded number."""
    return F.floor(8 * F.log2(size.cast("double"))).cast("int")


def reshard(docs: DataFrame, old: Column, shards: int = SHARDS, **carried: Column) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in each shard) of each document, under the law `rows`; and what is carried along."""
    text = whole_text()
    rows = stored(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), *(c.alias(name) for name, c in carried.items())).withColumn("class", size_class(F.col("size"))), "sizes")
    counted = rows.groupBy("old_shard", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # shards times size classes
    moves = transfers({(r["old_shard"], r["class"]): (r["n"], r["bytes"]) for r in counted}, shards)
    block = ["old_shard", "class"]
    # ranks within a block, the largest first: within cells of one size, after the rows of earlier cells; rows of one size, which may be a third of all, are dealt to several cells
    largest = max((r["n"] for r in counted), default=0)
    cells = max(1, -(-largest // CELL))
    celled = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    order = Window.partitionBy(*block).orderBy(F.desc("size"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = celled.groupBy(*block, "size", "cell").count().withColumn("before", F.sum("count").over(order))
    heads = heads.select(*block, "size", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = celled.withColumn("nth", F.row_number().over(Window.partitionBy(*block, "size", "cell").orderBy("doc_id", "text_crc32")))
    ranked = ranked.join(heads, [*block, "size", "cell"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    # each transfer: the ranks it takes, and the slots it fills
    taken, filled, plan = defaultdict(int), defaultdict(int), []
    for a, c, b, n in moves:
        plan.append((a, c, taken[a, c], taken[a, c] + n, b, filled[b]))
        taken[a, c] += n
        filled[b] += n
    plan = rows.sparkSession.createDataFrame(plan, "old_shard int, class int, first long, past long, shard int, at long")
    runs = plan.groupBy(*block).agg(F.collect_list(F.struct("first", "past", "shard", "at")).alias("runs"))  # bounded like the blocks
    placed = ranked.join(F.broadcast(runs), block).withColumn("run", F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["past"]))[0])
    return placed.select("doc_id", "size", "text_crc32", "old_shard", F.col("run.shard").alias("shard"), (F.col("run.at") + F.col("rank") - F.col("run.first")).alias("slot"), *carried)


def rewrite(docs: DataFrame, old: Column, folder: str, shards: int = SHARDS) -> list[int]:
    """Writes the shards that lose or gain rows, a folder shard=N for each, in as many files as their size asks for, and returns their numbers. Folders of untouched shards are left alone; those of shards that keep no row are deleted.

    The rows themselves go through placement, so null and repeated ids keep all their rows. folder may be the layout that docs was read from. A column `shard` of docs gives way to the new shard.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != "shard"]
    placed = stored(reshard(docs, old, shards, carried=F.struct(*own), lost=old.isNull()), "placed")
    moved = placed.where("lost or shard <> old_shard")
    touched = {r[0] for r in moved.select("shard").union(moved.where("not lost").select("old_shard")).distinct().collect()}  # a few numbers
    wanted = placed.where(F.col("shard").isin(*touched)).select("carried", "shard", "slot")
    filled = {r[0] for r in wanted.select("shard").distinct().collect()}
    gone = [str(n) for n in touched - filled] + ["__HIVE_DEFAULT_PARTITION__"] * (not placed.where("lost").isEmpty())
    dealt = wanted.repartition("shard", F.floor(F.col("slot") / CELL)).sortWithinPartitions("shard", "slot")
    dealt.select("carried.*", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return sorted(touched)
