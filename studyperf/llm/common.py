"""What several operators share: the shared scratch folder and the reading of texts."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D, which is also what bytes.split() parts at.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, which only local mode can share; on a cluster its lack is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it as read from there: later steps neither repeat its work nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds of the texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """docs for Python workers: doc_id (0 where there is none), unnamed, and the columns. Ids never become floating numbers there, which would round them."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), *columns)


def doc_ids(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The ids of a batch of identified()."""
    return pd.arrays.IntegerArray(batch["doc_id"].to_numpy("int64"), batch["unnamed"].to_numpy(bool))
