"""Drilling into one session: pages, windows, ranges, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, clamp_page
from ..functions.text import norm_text, snippet


def browse(docs: DataFrame, session_id: str, from_seq: int = 0, page_size: object = 20) -> DataFrame:
    """A page of indexed texts from ``from_seq`` on: seq, type, time, text, next_from_seq.

    A full page names the next page's first seq, even if nothing follows.
    """
    size = clamp_page(page_size, 100)
    page = docs.where((F.col("session_id") == session_id) & (F.col("seq") >= max(0, from_seq))).orderBy("seq").limit(size)
    whole = Window.partitionBy()  # over one page
    following = F.when(F.count("*").over(whole) == size, F.max("seq").over(whole) + 1)
    return page.select("seq", "type", F.nullif("time", F.lit(0)).alias("time"), norm_text(F.col("text")).alias("text"), following.alias("next_from_seq"))


def seq_range(events: DataFrame, session_id: str, low: int, high: int) -> DataFrame:
    """All events of a session with low <= seq <= high."""
    return events.where((F.col("session_id") == session_id) & F.col("seq").between(low, high))


def browse_range(events: DataFrame, session_id: str, from_seq: int = 0, page_size: object = 20) -> DataFrame:
    """The fallback page: a range of ``page_size`` seq numbers."""
    size = clamp_page(page_size)
    page = seq_range(events, session_id, from_seq, from_seq + size - 1)
    following = F.when(F.count("*").over(Window.partitionBy()) == size, F.lit(from_seq + size).cast("bigint"))
    return page.select("seq", "type", F.nullif("time", F.lit(0)).alias("time"), norm_text(F.col("text")).alias("text"), following.alias("next_from_seq"))


def window(events: DataFrame, session_id: str, seq: int, before: int = 3, after: int = 3) -> DataFrame:
    """The event ``seq`` with its neighbours of any type: seq, type, time, text.

    Neighbours are the nearest by seq on either side, found as two short top lists, so
    a long session is not sorted.
    """
    own = events.where(F.col("session_id") == session_id)
    hit = own.where(F.col("seq") == seq).select(F.lit(1).alias("hit"))
    left = own.where(F.col("seq") < seq).orderBy(F.desc("seq")).limit(before)
    right = own.where(F.col("seq") > seq).orderBy("seq").limit(after)
    around = own.where(F.col("seq") == seq).unionByName(left).unionByName(right)
    around = around.join(F.broadcast(hit.limit(1)))  # nothing if the event does not exist
    return around.select("seq", "type", F.nullif("time", F.lit(0)).alias("time"), norm_text(F.col("text")).alias("text"))


def hit_list(hits: DataFrame, query: str) -> DataFrame:
    """A session's hits with snippets: seq, type, time, text, score."""
    return hits.select("seq", "type", F.nullif("time", F.lit(0)).alias("time"), snippet(F.col("text"), query, SETTINGS.snippet_chars).alias("text"), "score")
