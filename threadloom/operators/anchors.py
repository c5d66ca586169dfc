"""Anchors after compaction: key fragments, their text, and how long they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import js_trim, norm_text

#: Labels and footer of an anchor's text.
SUMMARY, USER, ASSISTANT = "摘要:", "你", "助手"
FOOTER = "以上为本会话被压缩区间的摘要与关键原文片段。需要精确原文时用 recall 工具下钻:detail:{sessionId, seq} 或 detail:{sessionId, browse:true}。"


def fragments(summaries: DataFrame, events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Up to three messages of each summary's range: user messages first, then the longest.

    ``summaries`` has session_id, at (the summary's seq), low and high. Returned are
    session_id, at, rank, seq, type, text.
    """
    own = events.where(F.col("type").isin("user/message", "assistant/message") & (F.coalesce(js_trim("text"), F.lit("")) != ""))
    inside = summaries.select("session_id", "at", "low", "high").join(own, "session_id").where(F.col("seq").between(F.col("low"), F.col("high")))
    inside = inside.select("session_id", "at", "seq", "type", norm_text(F.col("text")).alias("text"))
    order = Window.partitionBy("session_id", "at").orderBy(F.when(F.col("type") == "user/message", 0).otherwise(1), F.desc(F.length("text")), "seq")
    return inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.anchor_fragments).select("session_id", "at", "rank", "seq", "type", "text")


def anchor_texts(summaries: DataFrame, events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """session_id, at and the anchor's text of each summary (session_id, at, low, high, summary)."""
    who = F.when(F.col("type") == "user/message", USER).otherwise(ASSISTANT)
    line = F.concat(F.lit("["), who, F.lit("#"), F.col("seq").cast("string"), F.lit("] "), F.substring("text", 1, s.anchor_fragment_chars))
    listed = fragments(summaries, events, s).groupBy("session_id", "at").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    both = summaries.join(listed, ["session_id", "at"], "left")
    head = js_trim(F.coalesce("summary", F.lit("")))
    top = F.when(head != "", F.concat(F.lit(SUMMARY), F.substring(head, 1, s.anchor_summary_chars)))
    lines = F.transform("l", lambda x: x["line"])
    return both.select("session_id", "at", F.concat_ws("\n", top, lines, F.lit(FOOTER)).alias("text"))


def active(log: DataFrame, rounds: int = SETTINGS.anchor_rounds) -> DataFrame:
    """Assemblies that show an anchor: session_id, seq, anchor_seq, round.

    ``log`` has session_id, seq and kind: ``summary`` sets the anchor, each ``assembly``
    shows it ``rounds`` times, ``disposed`` drops it. This is the batch twin of the
    stream in ``streaming.anchors``.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = F.last(F.when(F.col("kind").isin("summary", "disposed"), F.struct("seq", "kind")), ignorenulls=True).over(upto)
    marked = log.withColumn("reset", resets)
    since = Window.partitionBy("session_id", "reset.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.where("kind in ('summary', 'disposed', 'assembly') and reset.kind = 'summary'").withColumn("round", F.sum(F.when(F.col("kind") == "assembly", 1).otherwise(0)).over(since))
    return counted.where((F.col("kind") == "assembly") & (F.col("round") <= rounds)).select("session_id", "seq", F.col("reset.seq").alias("anchor_seq"), "round")
