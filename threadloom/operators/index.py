"""Search documents: numbering, postings, reconciliation, and the versioned store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import js_trim, ngrams, strip_text

INDEXED = ("user/message", "assistant/message")
_RUN, _SESSIONS, GRAM_BLOCK = 1024, 4096, 1 << 16


def searchable(events: DataFrame) -> DataFrame:
    """Events whose type is indexed and whose stripped text is not empty, with ``norm``.

    The filter stops at a text's first letter or digit, so what only counts documents cleans no texts.
    """
    own = events.where(F.col("type").isin(*INDEXED) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    return own.withColumn("norm", strip_text(F.col("text"))).withColumn("text", js_trim(F.col("text")))


def number_documents(docs: DataFrame) -> DataFrame:
    """Add ``rowid``: 1, 2, ... in order of (session_no, seq), without a global sort.

    Rows are counted in runs of seq numbers of a session, runs are summed within
    ranges of sessions, and ranges after one another; only the last step is not
    partitioned, over one row per range. A long session is thus many small windows.
    """
    # key of a run: session and seq // _RUN; rows inside a run are numbered by one window
    keyed = docs.withColumn("__run", F.floor(F.col("seq") / _RUN)).withColumn("__range", F.floor(F.col("session_no") / _SESSIONS))
    runs = keyed.groupBy("__range", "session_no", "__run").agg(F.count("*").alias("n"))
    ranges = runs.groupBy("__range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("__range").orderBy("session_no", "__run")
    starts = runs.select("__range", "session_no", "__run", (F.sum("n").over(inside) - F.col("n")).alias("start")).join(ranges, "__range")
    starts = starts.select("session_no", "__run", (F.col("before") + F.col("start")).alias("start"))
    own = F.row_number().over(Window.partitionBy("session_no", "__run").orderBy("seq"))
    numbered = keyed.withColumn("__own", own).join(starts, ["session_no", "__run"])
    return numbered.select((F.col("start") + F.col("__own")).alias("rowid"), *docs.columns)


def build_documents(events: DataFrame) -> DataFrame:
    """The document table of all events."""
    return number_documents(searchable(events))


def postings(docs: DataFrame, chars: int = SETTINGS.rerank_chars) -> DataFrame:
    """(rowid, session_id, n, gram) of the distinct 2- and 3-grams of each norm's prefix."""
    prefix = F.substring("norm", 1, chars)

    def grams(n: int) -> DataFrame:
        return docs.select("rowid", "session_id", F.lit(n).cast("tinyint").alias("n"), F.explode(F.array_distinct(ngrams(prefix, n))).alias("gram"))

    return grams(2).unionByName(grams(3))


def gram_blocks(docs: DataFrame) -> DataFrame:
    """(gram, block, offsets) of the lower-cased trigrams of whole norms.

    Rowids are kept in blocks of ``GRAM_BLOCK``: an offset is a rowid less the block's
    first, in ascending order, so that a frequent gram is a few short lists.
    """
    grams = docs.select("rowid", F.explode(F.array_distinct(ngrams(F.lower("norm"), 3))).alias("gram"))
    block = F.floor(F.col("rowid") / GRAM_BLOCK)
    placed = grams.select("gram", block.alias("block"), (F.col("rowid") - block * GRAM_BLOCK).cast("int").alias("offset"))
    return placed.groupBy("gram", "block").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))


def rows_with_grams(blocks: DataFrame, grams: list[str]) -> DataFrame:
    """rowid of the documents that hold any of some trigrams; the scan reads their ranges only."""
    own = blocks.where(F.col("gram").isin(grams))
    return own.select("block", F.explode("offsets").alias("offset")).select((F.col("block") * GRAM_BLOCK + F.col("offset")).alias("rowid")).distinct()


def fingerprints(events: DataFrame) -> DataFrame:
    """(id, fingerprint, n_events): ``count:last seq:last time:last type`` of each log."""
    last = F.max_by(F.struct("seq", "time", "type"), "seq")
    per = events.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_events"), last.alias("last"))
    text = F.concat_ws(":", F.col("n_events").cast("string"), F.col("last.seq").cast("string"), F.coalesce(F.col("last.time").cast("string"), F.lit("undefined")), "last.type")
    return per.select("id", text.alias("fingerprint"), "n_events")


def reconcile_plan(stored: DataFrame, live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What to do with each session: id, action, fingerprint, revision, from_seq.

    ``stored`` has id, fingerprint, revision, max_seq; ``live`` id and fingerprint;
    ``snapshots`` id and revision. Actions: reindex, meta (revision only), removed,
    skip. ``from_seq`` -1 rebuilds, otherwise only later events are added.
    """
    s = stored.select("id", F.col("fingerprint").alias("old_fp"), F.col("revision").alias("old_rev"), "max_seq", F.lit(True).alias("has_row"))
    x = live.select("id", F.col("fingerprint").alias("live_fp"), F.lit(True).alias("is_live"))
    y = snapshots.select("id", F.col("revision").alias("snap_rev"), F.lit(True).alias("is_snap"))
    all_ = s.join(x, "id", "full_outer").join(y, "id", "full_outer")
    row, is_live, is_snap = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_row", "is_live", "is_snap"))
    same_fp, same_rev = F.col("old_fp").eqNullSafe(F.col("live_fp")), F.col("old_rev").eqNullSafe(F.col("snap_rev"))
    action = (
        F.when(is_live & (~row | ~same_fp), "reindex").when(is_live & ~same_rev, "meta").when(is_live, "skip")
        .when(is_snap & (~row | ~same_rev), "reindex").when(is_snap, "skip").otherwise("removed")
    )
    new_fp = F.when(is_live, F.col("live_fp"))
    rebuild = ~row | (F.col("old_fp").isNull() & new_fp.isNull())
    planned = all_.withColumn("action", action).withColumn("new_fp", new_fp)
    return planned.select(
        "id", "action", F.when(F.col("action") == "reindex", F.col("new_fp")).otherwise(F.col("old_fp")).alias("fingerprint"),
        F.when(F.col("action").isin("reindex", "meta"), F.col("snap_rev")).otherwise(F.col("old_rev")).alias("revision"),
        F.when(F.col("action") == "reindex", F.when(rebuild, F.lit(-1)).otherwise(F.coalesce("max_seq", F.lit(-1)))).cast("bigint").alias("from_seq"),
    )


def removed_sessions(stored: DataFrame, live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stored ids that are neither live nor persisted any more."""
    return stored.select("id").join(live.select("id").unionByName(snapshots.select("id")), "id", "left_anti")


def append_delta(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents newer than their session's ``max_seq``; all of unknown sessions."""
    known = state.select(F.col("id").alias("session_id"), "max_seq")
    return docs.join(known, "session_id", "left").where(F.col("seq") > F.coalesce("max_seq", F.lit(-1))).drop("max_seq")


def reconcile_apply(stored_docs: DataFrame, current_docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The document table after a plan: rebuilt and removed sessions go, new documents come.

    A rebuilt session's ``max_seq`` starts at -1 again, so events that come back later
    are indexed.
    """
    p = plan.select(F.col("id").alias("session_id"), "action", "from_seq")
    dropped = p.where((F.col("action") == "removed") | (F.col("from_seq") == -1)).select("session_id")
    kept = stored_docs.join(dropped, "session_id", "left_anti")
    added = current_docs.join(p.where("action = 'reindex'").select("session_id", "from_seq"), "session_id").where("seq > from_seq").drop("from_seq")
    return kept.unionByName(added.select(*kept.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def max_seq(docs: DataFrame) -> DataFrame:
    """(id, max_seq) of the indexed documents."""
    return docs.groupBy(F.col("session_id").alias("id")).agg(F.max("seq").alias("max_seq"))


def stats(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: number of sessions and of documents."""
    return sessions.agg(F.count("*").alias("sessions")).join(F.broadcast(docs.agg(F.count("*").alias("docs"))))


def in_scope(docs: DataFrame, session_id: str | None = None, cwd: str | None = None) -> DataFrame:
    """Only one session's or one workspace's rows; the filter reaches the scan."""
    if session_id:
        return docs.where(F.col("session_id") == session_id)
    return docs.where(F.col("cwd") == cwd) if cwd else docs


def text_hash(text: Column) -> Column:
    """Key of a text's vector: an edited or reused row never inherits another's vector."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
