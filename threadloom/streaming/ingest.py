"""Streaming ingest of session logs into a document folder, and vector warm-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import strip_text
from ..operators.reconcile import append_batch
from ..operators.store import IndexStore
from ..sources.eventlog import searchable


def new_documents(events: DataFrame) -> DataFrame:
    """Documents of a stream of raw events, each (session_id, seq) once.

    State is bounded by a watermark of a day on event time; an event seen again within
    it, as after a restart of the writer, is dropped.
    """
    docs = searchable(events).withColumn("norm", strip_text(F.col("text"))).where("norm <> ''")
    stamped = docs.withColumn("ts", F.timestamp_millis(F.coalesce("time", F.lit(0))))
    return stamped.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["session_id", "seq"]).drop("ts")


def start_ingest(events: DataFrame, folder: str, checkpoint: str, interval: str | None = None):
    """Append the stream's documents to Parquet below ``folder``, dealt by session.

    The file sink's commit log makes a batch visible all at once and exactly once.
    """
    bucketed = new_documents(events).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(64)).cast("int"))
    writer = bucketed.writeStream.format("parquet").partitionBy("bucket").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def start_indexing(events: DataFrame, store: IndexStore, checkpoint: str, name: str):
    """Index a stream of events (see ``sources.conversations``) batch by batch, all that is there now.

    Each batch is one commit that bears its number under the stream's ``name``, so a batch
    that is replayed changes nothing, and a search sees each batch whole or not at all.
    """

    def take(batch: DataFrame, number: int) -> None:
        append_batch(store, batch, name, number)
        store.compact()

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_warmup(spark: SparkSession, engine, checkpoint: str, seconds: int = SETTINGS.warmup_seconds):
    """Call ``engine.warm()`` every so many seconds, until the query that is returned is stopped.

    How much a tick embeds is the engine's setting (fast or gentle); a tick that fails
    or takes longer than the interval only delays the next one.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: engine.warm()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
