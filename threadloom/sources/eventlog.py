"""Raw session logs: JSON lines or Parquet, live or persisted, batch or streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import indexed_text

MARKS = "file string, size bigint, lines int"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines logs (plain or gzip): one object per line with session_id,
    seq, type, time and data, whose ``data`` is kept as JSON text."""
    return _parsed(spark.read.text(path))


def read_changed(spark: SparkSession, folder: str, changed: DataFrame, most: int = 10_000) -> DataFrame:
    """Events of the sessions of ``changed`` (id), from a folder with one log ``<id>.jsonl`` (or ``.jsonl.gz``) per session.

    Up to ``most`` sessions are named to the scan, which then opens their files only;
    for more the whole folder is read and joined.
    """
    ids = [r["id"] for r in changed.select("id").distinct().limit(most + 1).collect()]
    lines = spark.read.text(folder)
    if len(ids) > most:
        return _parsed(lines).join(changed.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")
    return _parsed(lines.where(F.col("_metadata.file_name").isin([f"{i}{end}" for i in ids for end in (".jsonl", ".jsonl.gz")])))


def tail_log(spark: SparkSession, folder: str, marks: DataFrame | None = None, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(new events, new marks) of logs that grow at their end.

    ``marks`` (file, size, lines) say how far each file was read; None means not at all. Only
    files whose size has changed are opened, at most ``most`` of them; others come with the
    next call. A last line without its line feed is still being written: it is not counted and
    comes, whole, with a later call. A file that is shorter than its mark was begun
    anew and is read from its first line. Both results stand for the sizes that the files have
    now, also if they grow before the results are used. Marks are to be stored together
    with what was read, or after it.
    """
    seen = spark.createDataFrame([], MARKS) if marks is None else marks
    listed = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("now"))
    begin = F.when(F.col("now") < F.col("size"), 0).otherwise(F.coalesce("lines", F.lit(0))).cast("int")
    grown = listed.join(seen, "file", "left").where("size is null or now <> size").select("file", F.col("now").alias("size"), begin.alias("from"))
    todo = [tuple(r) for r in grown.orderBy("file").limit(most).collect()]
    if not todo:
        return _parsed(spark.createDataFrame([], "value string")), seen
    files = spark.read.format("binaryFile").load([f for f, _, _ in todo]).select(F.col("_metadata.file_path").alias("file"), "content")
    known = files.join(spark.createDataFrame(todo, "file string, size bigint, from int"), "file")
    lines = F.split(F.substring("content", F.lit(1), F.col("size").cast("int")).cast("string"), "\n")
    done = known.select("file", "size", "from", F.slice(lines, 1, F.size(lines) - 1).alias("done"))  # what follows the last line feed is torn or empty
    left = F.greatest(F.size("done") - F.col("from"), F.lit(0))
    new = done.select(F.explode(F.slice("done", F.col("from") + 1, left)).alias("value"))
    old = seen.join(done.select("file"), "file", "left_anti").select("file", "size", "lines")
    return _parsed(new), old.unionByName(done.select("file", "size", F.size("done").alias("lines")))


def stream_log(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The same as a stream of files that appear below ``path``."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path))


def _parsed(lines: DataFrame) -> DataFrame:
    get = lambda key: F.get_json_object("value", f"$.{key}")
    return lines.where(F.trim("value") != "").select(
        get("session_id").alias("session_id"), get("seq").cast("bigint").alias("seq"), get("type").alias("type"), get("time").cast("bigint").alias("time"), get("data").alias("data")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Events of a Parquet log with the schema of ``read_log``."""
    return spark.read.schema(schemas.EVENTS).parquet(path)


def searchable(events: DataFrame) -> DataFrame:
    """Events with text: session_id, seq, type, time, text."""
    return events.select("session_id", "seq", "type", "time", indexed_text(F.col("type"), F.col("data")).alias("text")).where("text <> ''")


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, judged queries) of a golden set in one JSON file, or with ``lines`` in one document a line.

    The file has ``sessions`` with id, cwd, createdAt and messages (seq, type, time,
    text), and ``queries`` with id, q and relevant ("session:seq" items). Sessions are
    numbered in order, from the document's ``first`` if it has that.
    """
    schema = (
        "first bigint, sessions array<struct<id: string, cwd: string, createdAt: bigint, messages: array<struct<seq: bigint, type: string, time: bigint, text: string>>>>, "
        "queries array<struct<id: string, q: string, relevant: array<string>>>"
    )
    whole = spark.read.schema(schema).option("multiLine", not lines).json(path)
    numbered = whole.select("first", F.posexplode("sessions").alias("at", "s")).withColumn("session_no", F.coalesce("first", F.lit(0)) + F.col("at"))
    docs = numbered.select("session_no", "s.*").select("session_no", F.col("id").alias("session_id"), "cwd", F.col("createdAt").alias("created_at"), F.explode("messages").alias("m"))
    docs = docs.select("session_no", "session_id", "cwd", "created_at", "m.*")
    queries = whole.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("qid"), F.col("q.q").alias("query"), F.col("q.relevant").alias("relevant"))
    return docs, queries


def first_existing(paths: list[str]) -> str | None:
    """The first path that is a non-empty file or a folder with files; None if none is."""
    for path in paths:
        if path and os.path.exists(path) and (os.path.isdir(path) and os.listdir(path) or os.path.isfile(path) and os.path.getsize(path)):
            return path
    return None
