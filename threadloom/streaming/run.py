"""Folders that all executors share, and draining a stored log through a stateful stream."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import SETTINGS
from .anchors import OUT, anchor_stream

KINDS = "session_id string, seq bigint, kind string"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may leave that unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="threadloom-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session leaves that to the cluster
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read back, without the plan that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain_anchors(spark: SparkSession, log: DataFrame, rounds: int = SETTINGS.anchor_rounds) -> DataFrame:
    """Store ``log`` as files, stream all of them through the anchors, return the output."""
    folder = shared_folder(spark)
    log.select("session_id", "seq", "kind").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(KINDS).parquet(f"{folder}/log")
    out = anchor_stream(stream, rounds).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
