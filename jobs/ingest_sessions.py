"""Keep tables of searchable messages and of sessions up to date with a growing folder of session logs.

    python -m jobs.ingest_sessions --config jobs/ingest_sessions.json \\
        --source LOGS --output MESSAGES --checkpoint CHECKPOINT

A run takes the Parquet files below ``--source`` (a folder, or a pattern such as
``logs/*.parquet`` for files and folders) that no run has taken before (the stream's
checkpoint knows), makes search documents of their turns and writes those that the output
does not have to ``messages``, partitioned by the month in which a session began and by
batch. A batch reads the keys of its own months only. Then it writes ``sessions`` anew for
these months: a row per session with its title (the opening of the user's first message),
number of messages, last number and times. A batch that is run again, since its run died,
overwrites its own partitions with the same rows. So a rerun changes nothing.

A message is known by session and number. Of several with one key the first batch's stays,
and within a batch the one that is first by type and text. Turns without session or
number cannot be asked for and are left out, so are those without letters or digits.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.settings import arguments, read_config
from threadloom.functions.text import norm_text
from threadloom.operators.index import searchable
from threadloom.sources.conversations import as_events

TURNS = "conv_id bigint, turn bigint, role string, text string"
MESSAGES = "session_id string, workspace string, created_at bigint, seq bigint, type string, time bigint, text string, norm string, month date, batch bigint"
SESSIONS = "session_id string, workspace string, title string, n_messages bigint, last_seq bigint, first_time bigint, last_time bigint, month date"
COLUMNS = [c.split()[0] for c in MESSAGES.split(", ")]
#: Turns from which a month's batch gets one file more, and months that a scan is told by name.
TURNS_PER_FILE, NAMED = 20_000, 1000
_MONTHS = pa.schema([("month", pa.date32()), ("files", pa.int32())])
DEFAULTS = {"files_per_batch": 64, "files_per_month": 8, "title_chars": 80}
log = logging.getLogger("ingest_sessions")


def month_of(created_at: Column) -> Column:
    """First day of the month of a time in milliseconds."""
    return F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(created_at / 86_400_000).cast("int")), "month")


def messages(turns: DataFrame) -> DataFrame:
    """Search documents of turns, one per (session_id, seq), with the month in which their session began."""
    docs = searchable(as_events(turns)).where("session_id is not null and seq is not null")
    first = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("type", "text"))
    return docs.withColumn("first", first).where("first = 1").select(
        "session_id", F.col("cwd").alias("workspace"), "created_at", "seq", "type", "time", "text", "norm", month_of(F.col("created_at")).alias("month")
    )


def summaries(docs: DataFrame, title_chars: int) -> DataFrame:
    """The rows of ``sessions`` for all messages of some months."""
    title = F.min_by("text", F.when(F.col("type") == "user/message", F.col("seq")))
    per = docs.groupBy("month", "session_id", "workspace").agg(
        title.alias("opening"), F.count("*").alias("n_messages"), F.max("seq").alias("last_seq"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )
    return per.withColumn("title", F.rtrim(F.substring(norm_text(F.col("opening")), 1, title_chars))).select(*(c.split()[0] for c in SESSIONS.split(", ")))


def read_messages(spark: SparkSession, output: str) -> DataFrame:
    """Messages as they stand."""
    return spark.read.schema(MESSAGES).parquet(f"{output}/messages")


def read_sessions(spark: SparkSession, output: str) -> DataFrame:
    """Sessions as they stand."""
    return spark.read.schema(SESSIONS).parquet(f"{output}/sessions")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Put ``rows`` in place of what the partitions that they belong to had."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _months(turns: DataFrame, most: int) -> DataFrame:
    """(month, files) of a batch's turns: a month has a file per ``TURNS_PER_FILE`` turns, at most ``most``; held by the driver, one row per month."""
    per = as_events(turns).where("session_id is not null").groupBy(month_of(F.col("created_at")).alias("month")).agg(F.count("*").alias("n"))
    files = F.least(F.lit(most), F.ceil(F.col("n") / TURNS_PER_FILE)).cast("int")
    return turns.sparkSession.createDataFrame(per.select("month", files.alias("files")).toArrow().cast(_MONTHS))


def _of(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of some months; few of them are named to the scan, of many their range, so that other partitions are not read."""
    named = [r["month"] for r in months.select("month").limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        return rows.where(F.col("month").isin(named))
    first, last = months.agg(F.min("month"), F.max("month")).first()
    return rows.where(F.col("month").between(first, last)).join(F.broadcast(months.select("month")), "month", "left_semi")


def _append(turns: DataFrame, batch: int, output: str, settings: dict) -> tuple[int, int]:
    """Write what is new in a batch; returns its numbers of turns and of messages written.

    Months are found before texts are looked at, so those are cleaned and compared once.
    """
    seen = Observation()
    spark, months = turns.sparkSession, _months(turns.observe(seen, F.count(F.lit(1)).alias("turns")), settings["files_per_month"])
    own = _of(read_messages(spark, output).where(F.col("batch") <= batch), months)
    keys = ["session_id", "seq", "month"]
    new = messages(turns).join(own.where(F.col("batch") < batch).select(*keys), keys, "left_anti")
    spread = F.pmod(F.xxhash64("session_id"), F.col("files"))
    rows = new.withColumn("batch", F.lit(batch).cast("bigint")).join(F.broadcast(months), "month").withColumn("spread", spread)
    _write(rows.repartition("month", "spread").sortWithinPartitions("month", "session_id", "seq").select(*COLUMNS), f"{output}/messages", "month", "batch")
    own = _of(read_messages(spark, output).where(F.col("batch") <= batch), months)
    _write(summaries(own, settings["title_chars"]).repartition("month"), f"{output}/sessions", "month")
    return seen.get["turns"], own.where(F.col("batch") == batch).count()


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Take what is new below ``source``; returns and logs the numbers of batches, turns read and messages written."""
    s, done = DEFAULTS | (settings or {}), {"batches": 0, "turns": 0, "messages": 0}
    for schema, name, by in ((MESSAGES, "messages", ["month", "batch"]), (SESSIONS, "sessions", ["month"])):  # from now on they can be read
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")

    def take(turns: DataFrame, batch: int) -> None:
        read, written = _append(turns, batch, output, s)
        log.info("batch %d: %d turns read, %d messages written to %s", batch, read, written, output)
        for name, n in (("batches", 1), ("turns", read), ("messages", written)):
            done[name] += n

    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %d turns of %s in %d batches, wrote %d messages", done["turns"], source, done["batches"], done["messages"])
    return done


if __name__ == "__main__":
    given = arguments(__doc__.split("\n")[0], "source", "output", "checkpoint")
    session = SparkSession.builder.appName("ingest_sessions").getOrCreate()
    try:
        run(session, given.source, given.output, given.checkpoint, read_config(session, given.config, DEFAULTS))
    finally:
        session.stop()
