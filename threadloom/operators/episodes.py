"""Episodes of neighbouring hits, groups per session, and text rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import snippet


def episodes_of(hits: DataFrame, keys: list[str], s: Settings = SETTINGS, texts: bool = False) -> DataFrame:
    """Runs of hits of a session with rowid gaps of at most ``episode_gap``, best first.

    ``keys`` are session_id or, for the hits of many queries, the query's id and
    session_id. Returned are the keys, episode (1 is the best), start_seq, end_seq, hit_count, score
    and with ``texts`` the best hit's text, the first of equals. At most ``episodes_per_session`` each.
    """
    w = Window.partitionBy(*keys).orderBy("rowid")
    new = F.when(F.col("rowid") - F.lag("rowid").over(w) <= s.episode_gap, 0).otherwise(1)
    runs = hits.select(*keys, "rowid", "seq", *(["text"] if texts else []), "score").withColumn("new", new)
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("score", (-F.col("rowid")).alias("minus"))
    per = runs.groupBy(*keys, "run").agg(
        F.min_by("seq", "rowid").alias("start_seq"), F.max_by("seq", "rowid").alias("end_seq"), F.count("*").alias("hit_count"),
        *([F.max_by("text", first).alias("text")] if texts else []), F.max("score").alias("score"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "run"))
    return per.withColumn("episode", rank).where(F.col("episode") <= s.episodes_per_session).drop("run")


def episodes(hits: DataFrame, query: str, s: Settings = SETTINGS) -> DataFrame:
    """``episodes_of`` one query's hits, with a snippet of the best hit: session_id, episode, start_seq, end_seq, hit_count, snippet, score."""
    top = episodes_of(hits, ["session_id"], s, texts=True)
    return top.select("session_id", "episode", "start_seq", "end_seq", "hit_count", snippet(F.col("text"), query).alias("snippet"), "score")


def session_groups(hits: DataFrame, query: str, limit: int, s: Settings = SETTINGS) -> DataFrame:
    """One row per session in order of its best hit, at most ``limit``.

    position, session_id, cwd, created_at, hit_time (0 becomes null), snippet, events
    (array of episodes without scores). ``hits`` is a merged, bounded hit list.
    """
    best = F.struct("score", (-F.col("rowid")).alias("minus"))
    per = hits.groupBy("session_id").agg(F.max(best).alias("best"), F.max_by("cwd", best).alias("cwd"), F.max_by("created_at", best).alias("created_at"), F.max_by("time", best).alias("time"))
    top = per.orderBy(F.desc("best.score"), F.desc("best.minus")).limit(limit)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("best.score"), F.desc("best.minus"))))  # over ``limit`` rows
    found = episodes(hits, query, s)
    item = F.struct("start_seq", "end_seq", "hit_count", "snippet")
    listed = found.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("episode", item.alias("e")))).alias("l"))
    events = F.transform("l", lambda x: x["e"])
    return top.join(listed, "session_id").select(
        "position", "session_id", F.nullif("cwd", F.lit("")).alias("cwd"), F.nullif("created_at", F.lit(0)).alias("created_at"),
        F.nullif("time", F.lit(0)).alias("hit_time"), events[0]["snippet"].alias("snippet"), events.alias("events"),
    )


def with_titles(groups: DataFrame, titles: DataFrame) -> DataFrame:
    """Add ``title`` from (id, title); null where there is none."""
    return groups.join(titles.withColumnRenamed("id", "session_id"), "session_id", "left")


def render(groups: DataFrame) -> DataFrame:
    """Lines of a coarse response: position, line (1 or 2), text."""
    title = F.coalesce(F.concat("title", F.lit(" ")), F.lit(""))
    place = F.coalesce(F.concat(F.lit(", "), "cwd"), F.lit(""))
    head = F.concat(F.lit("- "), title, F.lit("("), "session_id", place, F.lit(") — "), "snippet")
    spans = F.transform("events", lambda e: F.concat(F.lit("["), e["start_seq"].cast("string"), F.lit(".."), e["end_seq"].cast("string"), F.lit("]×"), e["hit_count"].cast("string")))
    more = F.concat(F.lit("  "), F.size("events").cast("string"), F.lit(" events: "), F.array_join(spans, ", "))
    lines = F.filter(F.array(F.struct(F.lit(1).alias("line"), head.alias("text")), F.struct(F.lit(2).alias("line"), F.when(F.size("events") > 1, more).alias("text"))), lambda x: x["text"].isNotNull())
    return groups.select("position", F.explode(lines).alias("l")).select("position", "l.line", "l.text")
