"""Reconciling a stored index with the logs: plan, changes and one commit."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import index
from .literal import word_postings
from .store import BY_ROW, LAST_ROWID, Draft, IndexStore

#: Sessions that a scan is told by name.
NAMED = 1000
log = logging.getLogger(__name__)


def _numbered_after(docs: DataFrame, last: int) -> DataFrame:
    """``docs`` with rowids after ``last``, in order of (session_no, seq)."""
    return index.number_documents(docs).withColumn("rowid", F.col("rowid") + last)


def add_documents(store: IndexStore, change: Draft, docs: DataFrame) -> DataFrame:
    """Number new documents after all that the store ever had, and write them with what is made of them; returns them.

    Postings and words are made where the store keeps them, from the documents as written.
    """
    last = store.mark(LAST_ROWID)
    if last is None:  # the documents were written as a whole
        last = store.read("docs", taken_away=True).agg(F.max("rowid")).first()[0] or 0
    added = change.add("docs", _numbered_after(docs, last))
    change.marks[LAST_ROWID] = max(last, added.agg(F.max("rowid")).first()[0] or 0)
    if store.holds("postings"):
        change.add("postings", index.postings(added))
    if store.holds("words"):
        change.add("words", word_postings(added))
    if store.holds("grams"):
        change.add("grams", index.gram_blocks(added))
    return added


def _rows_of(store: IndexStore, sessions: DataFrame) -> DataFrame | None:
    """rowid of the documents of some sessions, None if there are no sessions.

    Few sessions are named to the scan, which skips row groups without them.
    """
    ids = [r["session_id"] for r in sessions.select("session_id").limit(NAMED + 1).collect()]
    docs = store.read("docs").select("rowid", "session_id")
    if not ids:
        return None
    if len(ids) <= NAMED:
        return docs.where(F.col("session_id").isin(ids))
    return docs.join(sessions.select("session_id"), "session_id", "left_semi")


def reconcile(store: IndexStore, events: DataFrame, live: DataFrame, snapshots: DataFrame) -> dict[str, int]:
    """Bring the store up to date in one commit: {reindexed, meta, removed, added, gone}.

    ``events`` has all current events (see ``sources.conversations``), ``live`` (id,
    fingerprint), ``snapshots`` (id, revision). Only what changed is written: documents of
    sessions that are rebuilt or removed are taken away, new ones of reindexed sessions are added,
    and the rows of these sessions. A run that dies changes nothing; with nothing to do nothing is written.
    """
    store.refresh()
    known = store.read("sessions")
    plan = index.reconcile_plan(known.select("id", "fingerprint", "revision", "max_seq"), live, snapshots).where("action <> 'skip'").persist()
    try:
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        done = {"reindexed": counts.get("reindex", 0), "meta": counts.get("meta", 0), "removed": counts.get("removed", 0), "added": 0, "gone": 0}
        if not counts:
            return done
        change, by_id = store.draft(), plan.select(F.col("id").alias("session_id"), "action", "from_seq")
        if any(store.holds(t) for t in BY_ROW):
            old = _rows_of(store, by_id.where("action = 'removed' or from_seq = -1").join(known.select(F.col("id").alias("session_id")), "session_id", "left_semi"))
            done["gone"] = change.take_away(old) if old is not None else 0
        again = by_id.where("action = 'reindex'").select("session_id", "from_seq")
        new = index.searchable(events).join(again, "session_id").where("seq > from_seq").drop("from_seq")
        added = add_documents(store, change, new)
        done["added"] = added.count()
        _add_sessions(change, plan, known, events, added)
        change.commit()
        log.info("reconciled %s: %s", store.path, done)
        return done
    finally:
        plan.unpersist()


def _add_sessions(change: Draft, plan: DataFrame, known: DataFrame, events: DataFrame, added: DataFrame) -> None:
    """Rows of the planned sessions: new fingerprints and revisions, the largest seq that is indexed, or their end."""
    place = events.groupBy(F.col("session_id").alias("id")).agg(F.min("cwd").alias("now_cwd"), F.min("created_at").alias("now_created"))
    old = known.select("id", "cwd", "created_at", F.col("max_seq").alias("old_max"))
    touched = plan.where("action <> 'removed'").join(old, "id", "left").join(place, "id", "left").join(index.max_seq(added).withColumnRenamed("max_seq", "new_max"), "id", "left")
    kept = F.when(F.col("from_seq") == -1, F.lit(-1)).otherwise(F.coalesce("old_max", F.lit(-1)))
    change.add("sessions", touched.select(
        "id", F.coalesce("now_cwd", "cwd").alias("cwd"), F.coalesce("now_created", "created_at").alias("created_at"), "fingerprint", "revision",
        F.greatest(F.coalesce("new_max", F.lit(-1)), kept).cast("bigint").alias("max_seq"),
    ))
    change.add("sessions", plan.where("action = 'removed'").join(known.select("id", "cwd", "created_at", "max_seq"), "id"), removed=True)


def append_batch(store: IndexStore, events: DataFrame, stream: str, batch: int) -> int:
    """Index the new documents of a stream's batch in one commit; returns how many.

    The commit bears the batch's number, so a batch that comes again, after its stream
    restarted, changes nothing. Events at or below their session's stored ``max_seq`` are known.
    """
    store.refresh()
    name = f"stream-{stream}"
    if (store.mark(name) if store.mark(name) is not None else -1) >= batch:
        return 0
    first = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("type", "text"))
    docs = index.searchable(events).where("session_id is not null and seq is not null").withColumn("first", first).where("first = 1").drop("first")
    known = store.read("sessions")
    new = index.append_delta(docs, known.select("id", "max_seq"))
    change = store.draft()
    added = add_documents(store, change, new)
    per = added.groupBy(F.col("session_id").alias("id")).agg(F.min("cwd").alias("new_cwd"), F.min("created_at").alias("new_created"), F.max("seq").alias("new_max"))
    rows = per.join(known, "id", "left").select(
        "id", F.coalesce("cwd", "new_cwd").alias("cwd"), F.coalesce("created_at", "new_created").alias("created_at"), "fingerprint", "revision", F.col("new_max").alias("max_seq")
    )
    change.add("sessions", rows)
    n = added.count()
    change.commit(**{name: batch})
    return n
