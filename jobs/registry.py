"""The jobs as queries: each runs twice into one new folder, whose files stay, and gives its output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import answer_questions, ingest_sessions
from threadloom.plans.oracle import job_sql
from threadloom.streaming.run import shared_root


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job1_ingest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of ``conversations`` beside their sessions' rows, after a run that takes them and one that finds nothing new."""
    folder = _new_folder(spark, "job1")
    # the table may be one file, which a stream takes by pattern only
    for _ in range(2):
        ingest_sessions.run(spark, f"{sf_dir}/conversations.parquet*", f"{folder}/output", f"{folder}/checkpoint")
    sessions = ingest_sessions.read_sessions(spark, f"{folder}/output")
    return ingest_sessions.read_messages(spark, f"{folder}/output").drop("batch").join(sessions, ["month", "session_id", "workspace"], "full")


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and episodes that answer the benchmark's items, after two runs."""
    folder = _new_folder(spark, "job2")
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/answers")
    return answer_questions.read_answers(spark, f"{folder}/answers")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_ingest_sessions": job1_ingest_sessions, "job2_answer_questions": job2_answer_questions}
ORACLE_SQL_BY_NAME: dict[str, str] = job_sql()
