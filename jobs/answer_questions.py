"""Find the sessions that answer each of a table of questions, and the episodes in them.

    python -m jobs.answer_questions --config jobs/answer_questions.json \\
        --conversations TURNS --questions QUESTIONS --output ANSWERS

Every question (a row with item_id and text) is searched for by its n-grams in all
messages, whole texts against whole questions. Its best hits are put into episodes, hits that are
close to each other in a session, and the sessions with the best episodes are its answers. The
output is partitioned by workspace and written anew by each run, so a run that died, or
that ran before, leaves nothing behind.

Questions without two letters or digits have no n-grams and no answers; a question without
hits has no rows. Equal scores go to the earlier message.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.settings import arguments, read_config
from threadloom.functions.text import norm_text
from threadloom.operators import fuzzy
from threadloom.operators.episodes import episodes_of
from threadloom.operators.index import build_documents
from threadloom.sources.conversations import as_events

ANSWERS = "item_id bigint, place int, session_id string, episode int, start_seq bigint, end_seq bigint, hit_count bigint, score double, best_seq bigint, answer string, workspace string"
COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]
DEFAULTS = {"hits": 20, "least_score": 0.15, "sessions": 5, "answer_chars": 240}
log = logging.getLogger("answer_questions")


def answers(docs: DataFrame, questions: DataFrame, hits: int, least_score: float, sessions: int, answer_chars: int) -> DataFrame:
    """The columns of ``ANSWERS``: each question's best ``sessions`` and their episodes.

    place 1 is the best session; best_seq and answer are the number and the opening of its best hit.
    """
    found = fuzzy.search_many(docs, questions.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), hits, least_score)
    # at most ``hits`` rows per question
    opening = F.substring(norm_text(F.col("text")), 1, answer_chars).alias("opening")
    placed = docs.select("rowid", "session_id", F.col("cwd").alias("workspace"), "seq", opening).join(found.select("qid", "rowid", "score"), "rowid")
    best = F.struct("score", (-F.col("rowid")).alias("minus"))
    per = placed.groupBy("qid", "session_id", "workspace").agg(F.max(best).alias("best"), F.max_by("seq", best).alias("best_seq"), F.max_by("opening", best).alias("answer"))
    order = Window.partitionBy("qid").orderBy(F.desc("best.score"), F.desc("best.minus"))
    top = per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sessions).drop("best")
    told = top.join(episodes_of(placed, ["qid", "session_id"]), ["qid", "session_id"])
    return told.withColumnRenamed("qid", "item_id").select(*COLUMNS)


def read_answers(spark: SparkSession, output: str) -> DataFrame:
    """The output as it stands."""
    return spark.read.schema(ANSWERS).parquet(output)


def run(spark: SparkSession, conversations: str, questions: str, output: str, settings: dict | None = None) -> dict:
    """Answer all questions; returns and logs the numbers of turns, questions, answered questions and rows written."""
    s = DEFAULTS | (settings or {})
    turns, asked = spark.read.parquet(conversations), spark.read.parquet(questions)
    made = answers(build_documents(as_events(turns)), asked, s["hits"], s["least_score"], s["sessions"], s["answer_chars"])
    writer = made.repartition("workspace", F.pmod(F.xxhash64("item_id"), F.lit(8))).sortWithinPartitions("workspace", "item_id", "place", "episode").write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("workspace").parquet(output)
    written = read_answers(spark, output)
    answered, rows = written.agg(F.count_distinct("item_id"), F.count("*")).first()
    done = {"turns": turns.count(), "questions": asked.count(), "answered": answered, "rows": rows}
    log.info("read %d turns of %s and %d questions of %s", done["turns"], conversations, done["questions"], questions)
    log.info("wrote %d episodes of %d answered questions to %s", rows, answered, output)
    return done


if __name__ == "__main__":
    given = arguments(__doc__.split("\n")[0], "conversations", "questions", "output")
    session = SparkSession.builder.appName("answer_questions").getOrCreate()
    try:
        run(session, given.conversations, given.questions, given.output, read_config(session, given.config, DEFAULTS))
    finally:
        session.stop()
