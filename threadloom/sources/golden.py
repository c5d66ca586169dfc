"""Writing golden sets and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eventlog import read_golden

#: Messages of one document at most.
BLOCK = 1000


def round_trip(events: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write all sessions and queries as a golden set of JSON lines and read it.

    Each session is a document of its own (several, if it has sequence numbers of more
    than one ``BLOCK``), and so is each query, so that no task gathers the table.
    """
    from ..streaming.run import shared_folder

    spark = events.sparkSession
    message, no = F.struct("seq", "type", "time", "text"), F.col("session_no").cast("bigint")
    block = events.groupBy(no.alias("first"), F.col("session_id").alias("id"), "cwd", F.col("created_at").alias("createdAt"), F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    listed = block.select("first", F.array(F.struct("id", "cwd", "createdAt", "messages")).alias("sessions"))
    asked = queries.select(F.array(F.struct(F.col("qid").cast("string").alias("id"), F.col("query").alias("q"), F.array().cast("array<string>").alias("relevant"))).alias("queries"))
    path = shared_folder(spark) + "/golden"
    listed.unionByName(asked, allowMissingColumns=True).write.json(path)
    return read_golden(spark, path, lines=True)
