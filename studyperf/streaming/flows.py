"""Streams of appended facts: checked ingest, and running sums by day and week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import split


def source(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def checked_ingest(stream: DataFrame, table: str, valid: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Each batch is read once and appended to both folders. A batch that is repeated after a failure overwrites its own part."""

    def put(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            good, bad = split(kept, table)
            good.write.mode("overwrite").parquet(f"{valid}/lote={number}")
            bad.write.mode("overwrite").parquet(f"{rejected}/lote={number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_sums(stream: DataFrame, keys: list[str], ts: str = "data", late: str = "7 days", weekly: bool = False) -> DataFrame:
    """Minutes and rows by key and day, or week from Monday. Rows later than `late` behind the newest are dropped, so state is bounded."""
    window = F.window(ts, "7 days", "7 days", "4 days") if weekly else F.window(ts, "1 day")
    g = stream.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.sum("minutos_liquidos").alias("minutos"), F.count("*").alias("registros"))
    return g.select(*keys, F.to_date("w.start").alias("inicio"), "minutos", "registros")


def stored_sums(stream: DataFrame, keys: list[str], folder: str, checkpoint: str, ts: str = "data", late: str = "7 days", weekly: bool = False) -> StreamingQuery:
    """Running sums of closed windows, each written once: a day or week is appended when the newest row lies `late` beyond its end, and its state is dropped then. Rows that come for it after that are dropped.

    The watermark and the open windows are kept in the checkpoint, so a run that starts there goes on where the last one ended.
    """
    sums = running_sums(stream, keys, ts, late, weekly)
    return sums.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
