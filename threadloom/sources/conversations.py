"""Sessions and events from a table of conversation turns.

``conversations`` has conv_id, turn, role and text. Its turns stand for a session
log: the type is ``role/message``, system turns are events without searchable text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH, SESSION_MS, TURN_MS, WORKSPACES = 1_700_000_000_000, 100_000_000, 60_000, 4


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as events: session_no, session_id, cwd, created_at, seq, type, time, text."""
    return as_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Turns as events; ``session_no`` orders sessions."""
    created = F.lit(EPOCH) + F.col("conv_id") * SESSION_MS
    return conversations.select(
        F.col("conv_id").alias("session_no"), F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("/ws/"), (F.col("conv_id") % WORKSPACES).cast("string")).alias("cwd"), created.alias("created_at"),
        F.col("turn").alias("seq"), F.concat("role", F.lit("/message")).alias("type"), (created + F.col("turn") * TURN_MS).alias("time"), "text",
    )


def sessions(events: DataFrame) -> DataFrame:
    """One row per session: session_no, id, cwd, created_at."""
    return events.groupBy("session_no", "session_id").agg(F.min("cwd").alias("cwd"), F.min("created_at").alias("created_at")).withColumnRenamed("session_id", "id")


def titles(events: DataFrame) -> DataFrame:
    """Titles of the sessions that have one: every third."""
    return sessions(events).where("session_no % 3 = 0").select("id", F.concat(F.lit("Conversation "), "id").alias("title"))
