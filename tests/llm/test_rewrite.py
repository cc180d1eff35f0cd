"""Rewriting a layout of shards: every row once, untouched shards left alone."""

import os

from pyspark.sql import functions as F
from studyperf.llm import reshard


def layout(folder):
    return {d: sorted((f, os.stat(f"{folder}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("shard=")}


def test_rewrite_keeps_every_row(spark, tmp_path):
    # shard 0 has too many, 1 is right, 2 has too few, 5 is to go, and one row lies in no shard; ids are null or repeated
    rows = [(None if k % 4 else k // 8, f"text {k % 3}", f"note {k}", shard) for k, shard in enumerate([0] * 14 + [1] * 9 + [2] * 2 + [5] * 1 + [None])]
    folder = str(tmp_path / "layout")
    spark.createDataFrame(rows, "doc_id long, text string, note string, shard int").repartition(1).write.partitionBy("shard").parquet(folder)
    before, docs = layout(folder), spark.read.parquet(folder)
    assert reshard.rewrite(docs, F.col("shard"), folder, 3) == [0, 2, 5]
    after, found = layout(folder), spark.read.parquet(folder)
    assert after["shard=1"] == before["shard=1"] and sorted(after) == ["shard=0", "shard=1", "shard=2"]
    assert sorted(r["note"] for r in found.collect()) == sorted(r[2] for r in rows)
    assert {r["note"]: (r["doc_id"], r["text"]) for r in found.collect()} == {r[2]: r[:2] for r in rows}
    assert [r["count"] for r in found.groupBy("shard").count().collect()] == [9, 9, 9]
