"""The engine's own queries over the synthetic tables, by name.

``conversations`` stands for session logs (see ``sources.conversations``),
``embeddings`` for vectors: vec_id + 1 is a document's rowid. Each query has a twin in
``plans.oracle`` where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, detail, episodes, evaluate, fuzzy, hybrid, index, literal, reconcile, semantic, wordpiece
from ..operators.store import IndexStore
from ..sources import conversations as source
from ..streaming.anchors import TEXTS, start_anchor_texts
from ..streaming.ingest import start_indexing
from ..streaming.run import shared_folder
from . import built, oracle
from .oracle import LITERAL, ONE_CHAR, PHRASE, QUERY, SEMANTIC_MIN, SESSION, WORKSPACE, toy_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL_BY_NAME: dict[str, str] = oracle.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_events(spark, sf_dir)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built.index_store(spark, sf_dir).read("docs")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built.index_store(spark, sf_dir, "words").read("words")


def _unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.searchable(_events(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select((F.col("vec_id") + 1).alias("rowid"), F.col("embedding").alias("vec"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _vectors(spark, sf_dir).where("rowid = 1").first()
    return [float(x) for x in row["vec"]] if row else []


def _item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("qid"), T.strip_text(F.col("text")).alias("query"))


def _hits(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    return _search(spark, sf_dir, limit)


# ── sources ──────────────────────────────────────────────────────────────────


@query
def src_live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sessions (even numbers) with their numbers of events."""
    e = _events(spark, sf_dir).where("session_no % 2 = 0")
    return e.groupBy("session_id", "cwd", "created_at").agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"))


@query
def src_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted sessions (odd numbers) with a revision."""
    e = _events(spark, sf_dir).where("session_no % 2 = 1")
    return e.groupBy("session_id", "cwd").agg(F.concat(F.lit("r"), F.count("*").cast("string")).alias("revision"))


# ── text ─────────────────────────────────────────────────────────────────────


@query
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of every turn."""
    return _events(spark, sf_dir).select("session_id", "seq", T.strip_text(F.col("text")).alias("stripped"))


@query
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with single spaces."""
    return _events(spark, sf_dir).select("session_id", "seq", T.norm_text(F.col("text")).alias("norm"))


@query
def char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of raw and stripped texts, and the first and last stripped one."""
    s = T.strip_text(F.col("text"))
    return _events(spark, sf_dir).select("session_id", "seq", F.length("text").alias("n_raw"), F.length(s).alias("n_stripped"), F.substring(s, 1, 1).alias("first"), F.right(s, F.lit(1)).alias("last"))


@query
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trigrams of every whole stripped turn, in order."""
    return _events(spark, sf_dir).select("session_id", "seq", F.array_join(T.ngrams(T.strip_text(F.col("text")), 3), " ").alias("grams"))


@query
def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct bigrams of every whole stripped turn, sorted, and their number."""
    g = F.array_sort(F.array_distinct(T.ngrams(T.strip_text(F.col("text")), 2)))
    return _events(spark, sf_dir).select("session_id", "seq", F.size(g).alias("n"), F.array_join(g, " ").alias("grams"))


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw JSON events: users' content is a string, assistants' an array of blocks."""
    text = F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "text").alias("text"))
    call = F.struct(F.lit("tool-call").alias("type"), F.lit("x").alias("text"))
    blocks = F.to_json(F.struct(F.struct(F.array(text, call, text).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.concat(F.lit(" "), "text", F.lit("\n")).alias("content")))
    tool = F.to_json(F.struct(F.lit("read").alias("name"), F.concat(F.lit("{"), F.col("seq").cast("string"), F.lit("}")).alias("arguments")))
    e = _events(spark, sf_dir)
    kind = F.when(F.col("type") == "system/message", "tool/call").otherwise(F.col("type"))
    data = F.when(F.col("type") == "user/message", plain).when(F.col("type") == "assistant/message", blocks).otherwise(tool)
    return e.select("session_id", "seq", kind.alias("type"), "time", data.alias("data"))


@query
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable text of raw events in both content shapes."""
    return _raw_events(spark, sf_dir).select("session_id", "seq", "type", T.indexed_text(F.col("type"), F.col("data")).alias("text"))


@query
def event_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for reading of raw events, tool calls included."""
    return _raw_events(spark, sf_dir).select("session_id", "seq", "type", T.display_text(F.col("type"), F.col("data")).alias("text"))


@query
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets around the query's fragments in all documents."""
    return _unnumbered(spark, sf_dir).select("session_id", "seq", T.snippet(F.col("text"), QUERY).alias("snippet"))


@query
def bert_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as word pieces see them."""
    return _events(spark, sf_dir).select("session_id", "seq", T.bert_normalize(F.col("text")).alias("normalized"))


@query
def pre_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and punctuation marks of every turn."""
    p = T.pre_tokens(F.col("text"))
    return _events(spark, sf_dir).select("session_id", "seq", F.size(p).alias("n"), F.array_join(p, "|").alias("tokens"))


# ── index ────────────────────────────────────────────────────────────────────


@query
def idx_build_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table."""
    return index.build_documents(_events(spark, sf_dir)).select("rowid", "session_id", "seq", "type", "time", "norm")


@query
def docs_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined to their sessions' rows."""
    s = source.sessions(_events(spark, sf_dir)).select(F.col("id").alias("session_id"), F.col("cwd").alias("s_cwd"), F.col("created_at").alias("s_created"))
    return _docs(spark, sf_dir).select("rowid", "session_id", "seq").join(s, "session_id")


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of sessions and documents."""
    return index.stats(_unnumbered(spark, sf_dir), source.sessions(_events(spark, sf_dir)))


@query
def session_max_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest indexed seq of each session."""
    return index.max_seq(_unnumbered(spark, sf_dir))


@query
def session_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each log."""
    return index.fingerprints(_events(spark, sf_dir)).select("id", "fingerprint")


def _previous(events: DataFrame) -> DataFrame:
    """Events as they were: of every fifth session only the first three turns; every seventh is not known yet."""
    return events.where("session_no % 7 <> 1 and (session_no % 5 <> 0 or seq < 3)")


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, live, snapshots) for reconciliation."""
    e = _events(spark, sf_dir)
    before = _previous(e)
    rev = lambda n: F.concat(F.lit("r"), n.cast("string"))
    old = index.fingerprints(before).join(index.max_seq(index.searchable(before)), "id", "left").withColumn("no", F.col("id").cast("bigint"))
    live = F.col("no") % 2 == 0
    stored = old.select(
        "id", F.when(live, F.col("fingerprint")).alias("fingerprint"),
        F.when(~live, rev(F.col("n_events"))).when(F.col("no") % 11 == 0, F.lit("stale")).alias("revision"), F.coalesce("max_seq", F.lit(-1)).alias("max_seq"),
    )
    gone = old.where("no % 7 = 0").select(F.concat(F.lit("old-"), "id").alias("id"), "fingerprint", F.lit(None).cast("string").alias("revision"), F.lit(9).cast("bigint").alias("max_seq"))
    now = index.fingerprints(e).withColumn("no", F.col("id").cast("bigint"))
    return stored.unionByName(gone), now.where(F.col("no") % 2 == 0).select("id", "fingerprint"), now.where(F.col("no") % 2 == 1).select("id", rev(F.col("n_events")).alias("revision"))


@query
def idx_reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each session."""
    return index.reconcile_plan(*_state(spark, sf_dir))


@query
def idx_removed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sessions that are gone."""
    return index.removed_sessions(*_state(spark, sf_dir))


@query
def idx_append_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents newer than the stored state, by session."""
    stored, _, _ = _state(spark, sf_dir)
    return index.append_delta(_unnumbered(spark, sf_dir), stored).select("session_id", "seq", "type")


@query
def idx_reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table after the plan, counted by session."""
    stored, live, snapshots = _state(spark, sf_dir)
    plan = index.reconcile_plan(stored, live, snapshots)
    e = _events(spark, sf_dir)
    gone = _previous(e).where("session_no % 7 = 0").withColumn("session_id", F.concat(F.lit("old-"), "session_id"))
    old = index.searchable(_previous(e).unionByName(gone)).select("session_id", "seq", "text")
    after = index.reconcile_apply(old, index.searchable(e).select("session_id", "seq", "text"), plan)
    return after.groupBy("session_id").agg(F.count("*").alias("n_docs"), F.max("seq").alias("max_seq"), F.sum(F.length("text")).alias("chars"))


def _previous_store(spark: SparkSession, sf_dir: str, stored: DataFrame) -> IndexStore:
    """A store as it was before, with documents of sessions that are gone by now."""
    before = _previous(_events(spark, sf_dir))
    gone = before.where("session_no % 7 = 0").withColumn("session_id", F.concat(F.lit("old-"), "session_id"))
    events = before.unionByName(gone)
    store = IndexStore(spark, shared_folder(spark) + "/index")
    store.commit(docs=index.build_documents(events))
    docs = store.read("docs")
    known = source.sessions(events).drop("session_no").join(stored, "id")
    store.commit(postings=index.postings(docs), words=literal.word_postings(docs), sessions=known)
    return store


@query
def idx_reconcile_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a store after it was reconciled with the logs in one commit, and again, which changes nothing."""
    stored, live, snapshots = _state(spark, sf_dir)
    store = _previous_store(spark, sf_dir, stored)
    for _ in range(2):
        reconcile.reconcile(store, _events(spark, sf_dir), live, snapshots)
    per = store.read("docs").groupBy("session_id").agg(F.count("*").alias("n_docs"), F.max("seq").alias("max_seq"), F.sum(F.length("text")).alias("chars"))
    words = store.read("words").where("word <> ''").groupBy("session_id").agg(F.sum(F.size("positions")).alias("n_words"))
    known = store.read("sessions").select(F.col("id").alias("session_id"), "fingerprint", "revision")
    return per.join(words, "session_id").join(known, "session_id", "left")


@query
def idx_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a store that was built from a stream of three batches, each a stretch of every session."""
    folder = shared_folder(spark)
    e = _events(spark, sf_dir)
    store = IndexStore(spark, f"{folder}/index")
    empty = e.where("false")
    store.commit(docs=index.build_documents(empty), postings=index.postings(index.build_documents(empty)))
    for part in (F.col("seq") < 2, F.col("seq").between(2, 4), F.col("seq") > 4):  # the log grows, and the stream goes on
        e.where(part).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/log")
        start_indexing(stream, store, f"{folder}/checkpoint", "log").awaitTermination()
    per = store.read("docs").groupBy("session_id").agg(F.count("*").alias("n_docs"), F.sum(F.length("norm")).alias("chars"))
    grams = store.read("postings").groupBy("session_id").agg(F.count("*").alias("n_postings"))
    return per.join(grams, "session_id").join(store.read("sessions").select(F.col("id").alias("session_id"), "max_seq"), "session_id")


@query
def idx_upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sessions with the planned fingerprints and revisions."""
    stored, live, snapshots = _state(spark, sf_dir)
    plan = index.reconcile_plan(stored, live, snapshots).where("action in ('reindex', 'meta')").select("id", "fingerprint", "revision")
    return index.upsert(stored.select("id", "fingerprint", "revision"), plan, ["id"])


# ── candidates and fuzzy scores ──────────────────────────────────────────────


@query
def cand_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of the query's trigrams."""
    store = built.index_store(spark, sf_dir, "grams")
    return fuzzy.trigram_candidates_index(store.read("docs"), store.read("grams"), QUERY).select("rowid", "session_id", "seq")


@query
def cand_bigram_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number of the query's bigrams in the raw text."""
    return fuzzy.bigram_candidates(_docs(spark, sf_dir), QUERY)


@query
def cand_single_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a single character."""
    return _docs(spark, sf_dir).where(fuzzy.single_char_match(F.col("text"), ONE_CHAR)).select("rowid")


@query
def cand_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of any pass."""
    return _docs(spark, sf_dir).where(fuzzy.is_candidate(F.col("text"), F.col("norm"), QUERY)).select("rowid")


@query
def fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containment score of every document."""
    return _docs(spark, sf_dir).select("rowid", F.round(fuzzy.fuzzy_score(F.col("norm"), QUERY), 6).alias("score"))


@query
def fuzzy_single_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document for a single character."""
    return _docs(spark, sf_dir).select("rowid", F.round(fuzzy.fuzzy_score(F.col("norm"), ONE_CHAR), 6).alias("score"))


def _search(spark: SparkSession, sf_dir: str, limit: int, **scope) -> DataFrame:
    """A search through the stored postings."""
    store = built.index_store(spark, sf_dir, "postings")
    return fuzzy.search_index(store.read("docs"), store.read("postings"), QUERY, limit, **scope)


@query
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best hits in all sessions."""
    return _search(spark, sf_dir, 20).select("rowid", "session_id", "seq", "score")


@query
def fuzzy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of every benchmark item's whole stripped text."""
    return fuzzy.search_many(_docs(spark, sf_dir), _item_queries(spark, sf_dir), 20)


@query
def scope_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without a scope."""
    return _search(spark, sf_dir, 30).select("rowid", "session_id", "cwd", "score")


@query
def scope_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in one session."""
    return _search(spark, sf_dir, 30, session_id=SESSION, min_score=0.1).select("rowid", "session_id", "cwd", "score")


@query
def scope_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in one workspace."""
    return _search(spark, sf_dir, 30, cwd=WORKSPACE).select("rowid", "session_id", "cwd", "score")


# ── literal ──────────────────────────────────────────────────────────────────


@query
def literal_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of the words, by BM25."""
    return literal.bm25_index(_words(spark, sf_dir), LITERAL)


@query
def literal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the phrase, by spans."""
    return literal.search_sessions_index(_docs(spark, sf_dir), _words(spark, sf_dir), PHRASE, 50).select("session_id", "spans", "best_rowid")


@query
def literal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one session with the phrase."""
    return literal.search_events_index(_docs(spark, sf_dir), _words(spark, sf_dir), PHRASE, SESSION).select("rowid", "seq", "spans", "score")


# ── vectors ──────────────────────────────────────────────────────────────────


def _semantic_hits(spark: SparkSession, sf_dir: str, limit: int = 30) -> DataFrame:
    return semantic.search(_vectors(spark, sf_dir), _docs(spark, sf_dir), _query_vector(spark, sf_dir), limit, SEMANTIC_MIN, 64)


@query
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to the first vector."""
    return _semantic_hits(spark, sf_dir).select("rowid", "session_id", "seq", "score")


@query
def semantic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each fiftieth vector, among all vectors."""
    v = _vectors(spark, sf_dir)
    return semantic.search_many(v, v.where("(rowid - 1) % 50 = 0").select(F.col("rowid").alias("qid"), "vec"), 5, SEMANTIC_MIN)


@query
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with a vector."""
    return semantic.coverage(_docs(spark, sf_dir), _vectors(spark, sf_dir))


@query
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest documents without a vector, of vectors whose number is no multiple of 3."""
    return semantic.pending(_docs(spark, sf_dir), _vectors(spark, sf_dir).where("rowid % 3 <> 0"), 50).select("rowid", F.length("text").alias("chars"))


@query
def vec_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after storing new ones for each fourth document."""
    v = _vectors(spark, sf_dir).select("rowid", F.col("vec")[0].cast("double").alias("x"))
    new = v.where("rowid % 4 = 0").select((F.col("rowid") + 2).alias("rowid"), F.lit(9.0).alias("x"))
    return semantic.store(v, new).select("rowid", F.round("x", 5).alias("x"))


@query
def warmup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 64 documents to embed, in batches of similar length."""
    return semantic.warmup(_docs(spark, sf_dir), _vectors(spark, sf_dir).where("rowid % 3 <> 0")).select("rowid", "batch")


@query
def mean_pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each label's vectors (each fifth masked), scaled to length 1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tokens = e.select("label", F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1).alias("mask"))
    pooled = semantic.mean_pool_l2(tokens, ["label"])
    return pooled.select("label", F.posexplode("vec").alias("d", "x")).select("label", "d", (F.col("x") + 0.0).alias("x"))


# ── merging, groups ──────────────────────────────────────────────────────────


def _merged(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    return hybrid.merge(_semantic_hits(spark, sf_dir, 3 * limit), _hits(spark, sf_dir, 3 * limit), limit)


@query
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers' hits, merged."""
    return _merged(spark, sf_dir).select("rowid", "session_id", "score")


@query
def hybrid_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with semantic hits only behind the coverage gate."""
    d, v = _docs(spark, sf_dir), _vectors(spark, sf_dir)
    sem = hybrid.gated(_semantic_hits(spark, sf_dir), semantic.coverage(d, v))
    return hybrid.merge(sem, _hits(spark, sf_dir, 30), 10).select("rowid", "session_id", "score")


@query
def recall_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy hits of a phrase that has none, then its literal sessions instead."""
    d = _docs(spark, sf_dir)
    found = fuzzy.search(d, PHRASE, 30, min_score=1.01).select("session_id", F.lit("fuzzy").alias("layer"), "score")
    instead = literal.search_sessions_index(d, _words(spark, sf_dir), PHRASE, 10).select("session_id", F.lit("literal").alias("layer"), F.col("spans").cast("double").alias("score"))
    none = found.agg(F.count("*").alias("n")).where("n = 0").drop("n")  # one row if there are no hits
    return found.unionByName(instead.join(F.broadcast(none)))


@query
def episodes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the hits, at most three a session."""
    return episodes.episodes(_hits(spark, sf_dir), QUERY)


QUERIES["episodes"] = QUERIES.pop("episodes_")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.session_groups(_merged(spark, sf_dir), QUERY, 10)


@query
def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the merged hits."""
    spans = F.transform("events", lambda e: F.concat_ws(":", e["start_seq"].cast("string"), e["end_seq"].cast("string"), e["hit_count"].cast("string")))
    return _groups(spark, sf_dir).select("position", "session_id", "cwd", "created_at", "hit_time", "snippet", F.array_join(spans, " ").alias("events"))


@query
def title_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their titles."""
    e = _events(spark, sf_dir)
    groups = source.sessions(e).select(F.col("id").alias("session_id"), "cwd")
    return episodes.with_titles(groups, source.titles(e))


@query
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the coarse response."""
    return episodes.render(episodes.with_titles(_groups(spark, sf_dir), source.titles(_events(spark, sf_dir))))


# ── detail ───────────────────────────────────────────────────────────────────


@query
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a session's texts."""
    return detail.browse(_docs(spark, sf_dir), SESSION, 1, 3)


@query
def browse_seq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as a range of seq numbers, all types."""
    return detail.browse_range(_events(spark, sf_dir), SESSION, 1, 3)


@query
def seq_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events in a range."""
    return detail.seq_range(_events(spark, sf_dir), SESSION, 1, 4).select("seq", "type", "text")


@query
def detail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event with two neighbours to each side."""
    return detail.window(_events(spark, sf_dir), SESSION, 2, 2, 2)


@query
def detail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of one session with snippets."""
    return detail.hit_list(_search(spark, sf_dir, 30, session_id=SESSION, min_score=0.1), QUERY)


# ── anchors ──────────────────────────────────────────────────────────────────


def _anchor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as anchor log: sign-ups are summaries, views assemblies, errors end a session."""
    kind = F.when(F.col("event_type") == "signup", "summary").when(F.col("event_type") == "view", "assembly").when(F.col("event_type") == "error", "disposed")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind")).where("kind is not null")


@query
def anchor_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assemblies that show an anchor."""
    return anchors.active(_anchor_log(spark, sf_dir))


@query
def anchor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream with keyed state, drained into a table."""
    from ..streaming.run import drain_anchors

    return drain_anchors(spark, _anchor_log(spark, sf_dir))


def _summaries(events: DataFrame) -> DataFrame:
    """A summary at the end of each session, of all its turns."""
    last = events.groupBy("session_id").agg(F.max("seq").alias("high"))
    return last.select("session_id", (F.col("high") + 1).alias("at"), F.lit(0).alias("low"), "high", F.concat(F.lit(" Summary of "), "session_id").alias("summary"))


@query
def anchor_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key fragments of each summary's range."""
    e = _events(spark, sf_dir)
    return anchors.fragments(_summaries(e), e)


@query
def anchor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors' texts."""
    e = _events(spark, sf_dir)
    return anchors.anchor_texts(_summaries(e), e)


@query
def anchor_text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of summaries, two files a batch."""
    folder, e = shared_folder(spark), _events(spark, sf_dir)
    summaries = _summaries(e)
    summaries.repartition(4, "session_id").write.parquet(f"{folder}/summaries")
    stream = spark.readStream.schema(summaries.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/summaries")
    start_anchor_texts(stream, lambda: e, f"{folder}/texts", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(TEXTS).parquet(f"{folder}/texts").drop("batch")


# ── evaluation ───────────────────────────────────────────────────────────────


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ranked, judged): documents by source and n_chars against quality labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("key"), rank.alias("rank")).where(F.col("rank") <= 20)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    good = docs.join(labels, "doc_id").groupBy("source").agg(F.collect_list(F.col("doc_id").cast("string")).alias("relevant"))
    judged = docs.select("source").distinct().join(good, "source", "left").select(F.col("source").alias("qid"), F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    empty = judged.select(F.concat("qid", F.lit("-none")).alias("qid"), F.array().cast("array<string>").alias("relevant")).where("qid like '%1-none'")
    more = ranked.where("rank <= 6 and qid = 'src1'").withColumn("qid", F.lit("src1-none"))
    return ranked.unionByName(more), judged.unionByName(empty)


@query
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and gain of each query."""
    return evaluate.metrics(*_ranked(spark, sf_dir))


@query
def ir_metrics_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their means."""
    return evaluate.averages(evaluate.metrics(*_ranked(spark, sf_dir)))


@query
def ir_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without relevant documents that still have hits."""
    return evaluate.false_positives(*_ranked(spark, sf_dir))


# ── word pieces, embeddings, golden sets ─────────────────────────────────────


@query
def wordpiece_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with a toy vocabulary."""
    t = wordpiece.encode_texts(_docs(spark, sf_dir), toy_vocabulary())
    return t.select("rowid", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


QUERIES["wordpiece"] = QUERIES.pop("wordpiece_")


@query
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with a toy vocabulary."""
    t = wordpiece.encode_texts(_docs(spark, sf_dir), toy_vocabulary())
    return t.select("rowid", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query
def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every document from the hashing embedder."""
    e = semantic.embed_documents(_docs(spark, sf_dir), lambda: semantic.HashingEmbedder(32))
    return e.select("rowid", F.posexplode("vec").alias("d", "x")).select("rowid", "d", F.col("x").cast("double").alias("x"))


@query
def src_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and benchmark items written as a golden set and read back: documents per session."""
    from ..sources.golden import round_trip

    docs, queries = round_trip(_events(spark, sf_dir), _item_queries(spark, sf_dir))
    return docs.groupBy("session_id").agg(F.count("*").alias("n"), F.max("seq").alias("last")).join(F.broadcast(queries.agg(F.count("*").alias("queries"))))
