"""Commits that add, take away and are put on top of each other; reconciling, streaming, the word index."""

import json
import random
import re
import threading

import pytest

from threadloom.engine import Engine
from threadloom.functions.text import strip_literal, word_list
from threadloom.operators import fuzzy, index, literal, reconcile
from threadloom.operators.store import IndexStore
from threadloom.streaming.ingest import start_indexing

EVENTS = "session_no bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string"
SESSIONS = "id string, cwd string, created_at bigint, fingerprint string, revision string, max_seq bigint"
draw = random.Random(31)
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "a", "a", "straße", "日本語", "x1"]


def talk(sessions, numbers):
    return [(n, str(n), f"/ws/{n % 2}", 1000 + n, k, "user/message" if k % 3 else "system/message", 10 * k, f"{n} {k} " + " ".join(draw.choice(WORDS) for _ in range(20))) for n in sessions for k in numbers]


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def content(store):
    docs = sorted((r.session_id, r.seq, r.text) for r in store.read("docs").collect())
    rowids = {r.rowid for r in store.read("docs").collect()}
    assert {r.rowid for r in store.read("postings").select("rowid").distinct().collect()} == {r.rowid for r in store.read("words").select("rowid").distinct().collect()} == rowids
    assert len(rowids) == len(docs)
    if store.holds("grams"):
        for query in ("alphabeta", "straße", "語x1"):
            by_index, scanned = fuzzy.trigram_candidates_index(store.read("docs"), store.read("grams"), query), fuzzy.trigram_candidates(store.read("docs"), query)
            assert sorted(r.rowid for r in by_index.collect()) == sorted(r.rowid for r in scanned.collect())
    return docs


def expected(rows):
    return sorted((r[1], r[4], r[7]) for r in rows if r[5] == "user/message")


@pytest.fixture
def base(spark, tmp_path):
    rows = talk(range(60), range(12))
    events = spark.createDataFrame(rows, EVENTS)
    store = IndexStore(spark, str(tmp_path / "index"))
    store.commit(docs=index.build_documents(events))
    docs = store.read("docs")
    known = events.groupBy("session_id").agg({"cwd": "min", "created_at": "min"}).toDF("id", "cwd", "created_at").join(index.fingerprints(events), "id").join(index.max_seq(docs), "id")
    store.commit(postings=index.postings(docs), words=literal.word_postings(docs), grams=index.gram_blocks(docs), sessions=known.selectExpr("id", "cwd", "created_at", "fingerprint", "cast(null as string) revision", "max_seq"))
    return store, rows


def states(spark, rows):
    events = spark.createDataFrame(rows, EVENTS)
    return events, index.fingerprints(events).select("id", "fingerprint"), spark.createDataFrame([], "id string, revision string")


def test_reconcile_in_one_commit(spark, base, tmp_path):
    store, rows = base
    root = tmp_path / "index"
    before = set(root.iterdir())
    grown = [r for r in rows if r[1] != "7"] + talk([3], range(12, 16)) + talk([60], range(5))
    done = reconcile.reconcile(store, *states(spark, grown))
    assert done == {"reindexed": 2, "meta": 0, "removed": 1, "added": len(expected(talk([3], range(12, 16)) + talk([60], range(5)))), "gone": 8}
    assert content(store) == expected(grown) == content(IndexStore(spark, store.path))
    folders = [f for f in set(root.iterdir()) - before if f.is_dir()]
    assert len(folders) == 1 and size(folders[0]) < 0.25 * size(root)  # what is written is what changed
    assert not (folders[0] / "vectors").exists()
    known = {r.id: (r.max_seq, r.fingerprint) for r in store.read("sessions").collect()}
    assert "7" not in known and known["3"][0] == 14 and known["60"] == (4, "5:4:40:user/message") and len(known) == 60
    pointers = sorted(root.glob("_meta-*.json"))
    assert reconcile.reconcile(store, *states(spark, grown)) == {"reindexed": 0, "meta": 0, "removed": 0, "added": 0, "gone": 0}
    assert sorted(root.glob("_meta-*.json")) == pointers  # nothing to do, nothing written
    back = grown + [r for r in rows if r[1] == "7"]
    assert reconcile.reconcile(store, *states(spark, back))["added"] == 8 and content(store) == expected(back)
    query = "alpha beta gamma"
    got, want = (x.collect() for x in (fuzzy.search_index(store.read("docs"), store.read("postings"), query, 50), fuzzy.search(store.read("docs"), query, 50)))
    assert got == want and len(got) == 50


def test_sessions_that_are_rebuilt(spark, base):
    """Two revisions without fingerprints: old documents go, all of the log come."""
    store, rows = base
    old = store.read("sessions").where("id = '5'").selectExpr("id", "cwd", "created_at", "cast(null as string) fingerprint", "'r1' revision", "max_seq")
    change = store.draft()
    change.add("sessions", old)
    change.commit()
    now = [r for r in rows if r[1] != "5"] + talk([5], range(1, 3))
    events, live, _ = states(spark, now)
    done = reconcile.reconcile(store, events, live.where("id <> '5'"), spark.createDataFrame([("5", "r2")], "id string, revision string"))
    assert (done["reindexed"], done["added"], done["gone"]) == (1, 2, 8) and content(store) == expected(now)
    assert store.read("sessions").where("id = '5'").select("revision", "max_seq").first() == ("r2", 2)


def test_rowids_are_never_given_twice(spark, base, monkeypatch):
    """Also after the last documents were taken away and all was compacted; many sessions go by a join."""
    store, rows = base
    monkeypatch.setattr(reconcile, "NAMED", 3)
    now = [r for r in rows if r[0] < 50] + talk([80], range(4))
    reconcile.reconcile(store, *states(spark, now))
    assert store.mark("last_rowid") == 482 and content(store) == expected(now)
    reconcile.reconcile(store, *states(spark, now[:-4]))
    store.compact(always=True)
    assert store.mark("last_rowid") == 482 and store.read("docs").agg({"rowid": "max"}).first()[0] == 400
    assert sorted(map(tuple, store.read("grams").collect())) == sorted(map(tuple, index.gram_blocks(store.read("docs")).collect()))
    reconcile.reconcile(store, *states(spark, now))
    assert content(store) == expected(now) and store.mark("last_rowid") == 484


@pytest.mark.parametrize("step", ["take_away", "docs", "postings", "words", "sessions", "commit"])
def test_a_run_that_dies_changes_nothing(spark, base, monkeypatch, step):
    from threadloom.operators.store import Draft

    store, rows = base
    grown = [r for r in rows if r[1] != "7"] + talk([3], range(12, 14))
    kept = {"add": Draft.add, "take_away": Draft.take_away}

    def add(self, table, *rest, **more):
        if table == step:
            raise InterruptedError(step)
        return kept["add"](self, table, *rest, **more)

    def die(*_, **__):
        raise InterruptedError(step)

    with monkeypatch.context() as m:
        m.setattr(Draft, "add", add)
        if step in ("take_away", "commit"):
            m.setattr(Draft, step, die)
        with pytest.raises(InterruptedError):
            reconcile.reconcile(store, *states(spark, grown))
    assert content(IndexStore(spark, store.path)) == expected(rows)
    reconcile.reconcile(store, *states(spark, grown))
    assert content(store) == expected(grown)


def test_two_writers(spark, base):
    """Changes of different tables both land, of the same table only the first."""
    store, rows = base
    other = IndexStore(spark, store.path)
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "rowid bigint, vec array<float>")
    mine, theirs, late = store.draft(), other.draft(), IndexStore(spark, store.path).draft()
    mine.add("vectors", vectors)
    theirs.add("docs", store.read("docs").limit(0))
    late.add("vectors", vectors)
    theirs.commit()
    mine.commit()
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit()
    assert store.read("vectors").count() == 2 and len(store._current["tables"]["docs"]) == 2 and content(store) == expected(rows)


def test_a_pointer_that_is_being_written_is_waited_for(spark, base, tmp_path):
    """A commit on top of one whose pointer is not whole yet keeps its change."""
    store, rows = base
    other = IndexStore(spark, store.path)
    first = other.draft()
    first.add("docs", store.read("docs").limit(0))
    first.commit()
    newest = max((tmp_path / "index").glob("_meta-*.json"))
    whole = newest.read_text()
    newest.write_text("")  # as if its writer had only begun
    (tmp_path / "index" / f".{newest.name}.crc").unlink(missing_ok=True)
    writer = threading.Timer(1.5, lambda: newest.write_text(whole))
    writer.start()
    mine = store.draft()
    mine.add("vectors", spark.createDataFrame([(1, [1.0])], "rowid bigint, vec array<float>"))
    mine.commit()
    writer.join()
    assert len(store._current["tables"]["docs"]) == 2 and store.read("vectors").count() == 1 and content(store) == expected(rows)


def test_taken_away_and_compacted(spark, base, tmp_path):
    store, rows = base
    store.draft().commit()
    change = store.draft()
    change.add("vectors", store.read("docs").selectExpr("rowid", "array(1f) vec"))
    change.commit()
    assert store.compact() is False
    change = store.draft()
    assert change.take_away(store.read("docs").where("rowid % 3 = 0").select("rowid")) == 160
    change.commit()
    assert store.read("docs").where("rowid % 3 = 0").count() == 0 and store.read("vectors").count() == 320
    with pytest.raises(ValueError, match="compact"):
        store.commit(docs=store.read("docs"))
    left = content(store)
    assert store.compact() is True and content(store) == left and store.read("vectors").count() == 320
    assert "gone" not in store._current["tables"] and max(map(len, store._current["tables"].values())) == 1
    store.clean(0)
    assert content(IndexStore(spark, store.path)) == left and len([f for f in (tmp_path / "index").iterdir() if f.is_dir()]) == 1
    for _ in range(17):
        change = store.draft()
        change.add("vectors", store.read("vectors").limit(0))
        change.commit()
    assert store.compact() is True and content(store) == left


def test_warm_up_writes_new_vectors_only(spark, base, tmp_path):
    from threadloom.config import Settings
    from threadloom.operators.semantic import HashingEmbedder

    store, rows = base
    engine = Engine.of(store, embedder=HashingEmbedder(16), settings=Settings(warmup="fast"))
    sizes = []
    for _ in range(3):
        before = set((tmp_path / "index").iterdir())
        assert engine.warm(64) == 64
        new = [f for f in set((tmp_path / "index").iterdir()) - before if f.is_dir()]
        sizes.append(sum(map(size, new)))
    assert store.read("vectors").count() == store.read("vectors").select("rowid").distinct().count() == 192
    assert sizes[2] < 1.5 * sizes[0]


def test_requests_bring_the_store_up_to_date(spark, base):
    store, rows = base
    now, broken = [rows], []

    def logs():
        if broken:
            raise OSError("no logs")
        return states(spark, now[0])

    engine = Engine.of(store, events=spark.createDataFrame(rows, EVENTS), logs=logs)
    assert not engine.recall("qqzz wwkk", scope="all").groups
    version = store.version
    now[0] = rows + [(70, "70", "/ws/0", 1070, 1, "user/message", 1, "qqzz wwkk of a new session"), (3, "3", "/ws/1", 1003, 50, "user/message", 1, "another qqzz wwkk")]
    assert {g["session_id"] for g in engine.recall("qqzz wwkk", scope="all").groups} == {"70", "3"} and store.version != version
    page = engine.recall("x", detail={"sessionId": "3", "browse": True, "fromSeq": 11, "pageSize": 3}).groups[0]
    assert [c["seq"] for c in page["context"]] == [11, 50]
    now[0] = rows
    hits = engine.recall("qqzz", detail={"sessionId": "3"}).groups[0]["context"]
    assert [c["seq"] for c in hits] == [50]  # a log only grows, so what was indexed stays
    assert {g["session_id"] for g in engine.recall("qqzz wwkk", scope="all").groups} == {"3"}  # unless its session is gone
    assert content(store) == sorted([*expected(rows), ("3", 50, "another qqzz wwkk")])
    broken.append(1)
    found = engine.recall("alpha", scope="all")
    assert found.ok and found.groups and all(g["events"] == [] for g in found.groups)  # phrases instead
    page = engine.recall("x", detail={"sessionId": "3", "browse": True, "fromSeq": 0, "pageSize": 4}).groups[0]
    assert [c["seq"] for c in page["context"]] == [0, 1, 2, 3] and page["next_from_seq"] == 4  # all types, by number


def test_stream_of_batches(spark, tmp_path):
    rows = [talk(range(20), range(0, 5)), talk(range(10, 30), range(5, 9)), talk(range(40), [2, 9])]
    empty = index.build_documents(spark.createDataFrame([], EVENTS))
    store = IndexStore(spark, str(tmp_path / "index"))
    store.commit(docs=empty, postings=index.postings(empty), words=literal.word_postings(empty))
    seen, want = [], {}
    for batch in rows:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "log"))
        start_indexing(stream, store, str(tmp_path / "checkpoint"), "log").awaitTermination()
        known = {s: max(k for t, k in want if t == s) for s in {s for s, _ in want}}
        want |= {(s, k): t for s, k, t in expected(batch) if k > known.get(s, -1)}
        assert content(IndexStore(spark, store.path)) == sorted((*k, t) for k, t in want.items())
        seen.append(fuzzy.search_index(store.read("docs"), store.read("postings"), "alpha beta", 100).count())
    assert 0 < seen[0] <= seen[1] <= seen[2]
    version, docs = store.version, content(store)
    assert reconcile.append_batch(store, spark.createDataFrame(talk([99], range(3)), EVENTS), "log", 2) == 0  # comes again
    assert store.version == version and content(store) == docs
    assert reconcile.append_batch(store, spark.createDataFrame(talk([99], range(3)), EVENTS), "other", 0) == 2
    assert json.loads(max((tmp_path / "index").glob("_meta-*.json")).read_text())["marks"] == {"stream-log": 2, "stream-other": 0, "last_rowid": store.read("docs").count()}


PHRASES = ["of the", "a a", "a a a", "alpha", "the straße", "日本語", "nothing here", "", "…", "of the of", "Alpha BETA"]


@pytest.mark.parametrize("query", PHRASES)
def test_word_index_equals_scan(base, query):
    store, _ = base
    docs, words = store.read("docs"), store.read("words")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(literal.bm25_index(words, query)) == rows(literal.bm25(docs, query))
    assert rows(literal.bm25_index(words, query, 5)) == rows(literal.bm25(docs, query, 5))
    names = ["session_id", "cwd", "created_at", "spans", "best_rowid"]
    assert rows(literal.search_sessions_index(docs, words, query, 7).select(*names)) == rows(literal.search_sessions(docs, query, 7).select(*names))
    for scope in ({"session_id": "3"}, {"cwd": "/ws/1"}):
        got, want = literal.search_sessions_index(docs, words, query, 7, **scope), literal.search_sessions(index.in_scope(docs, **scope), query, 7)
        assert rows(got.select(*names)) == rows(want.select(*names))
    for session in (None, "3"):
        got, want = literal.search_events_index(docs, words, query, session), literal.search_events(docs, query, session)
        assert rows(got.select("rowid", "seq", "spans", "score")) == rows(want.select("rowid", "seq", "spans", "score"))


def test_many_queries_by_the_word_index(spark, base):
    store, _ = base
    queries = spark.createDataFrame(list(enumerate(PHRASES)), "qid int, query string")
    got = {}
    for r in literal.bm25_many(store.read("words"), queries, 9).collect():
        got.setdefault(r.qid, []).append((r.rowid, r.score))
    want = {k: [(r.rowid, r.score) for r in literal.bm25(store.read("docs"), q, 9).collect()] for k, q in enumerate(PHRASES)}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_only_the_query_words_are_read(base):
    store, _ = base
    plan = literal.bm25_index(store.read("words"), "alpha of")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<([^>]*)", plan)
    assert len(filters) >= 2 and all("In(word, [alpha,of])" in f or "EqualTo(word,)" in f for f, _ in filters), filters
    assert not any("text" in columns for _, columns in filters)
    rows = store.read("words").where("word = 'alpha'").collect()
    texts = {r.rowid: word_list(r.text) for r in store.read("docs").collect()}
    assert {r.rowid: r.positions for r in rows} == {k: [i for i, w in enumerate(t) if w == "alpha"] for k, t in texts.items() if "alpha" in t}
    assert all(r.len == len(texts[r.rowid]) for r in rows) and strip_literal("a") == "a"


def test_whole_texts_are_in_the_gram_index(spark):
    texts = ["x" * 5000 + "needle", "İstanbul NEEDLE", "nee dle", "need", "", "ab", "日本語" * 700]
    docs = spark.createDataFrame([(k * 40_000, t, strip_literal(t)) for k, t in enumerate(texts)], "rowid bigint, text string, norm string")
    blocks = index.gram_blocks(docs)
    assert blocks.where("gram = 'xxx'").collect() == [("xxx", 0, [0])]
    for query in ("needle", "İst", "istanbul", "語日本", "ab", "zzz", "STA"):
        got = {r.rowid for r in fuzzy.trigram_candidates_index(docs, blocks, query).collect()}
        assert got == {r.rowid for r in fuzzy.trigram_candidates(docs, query).collect()}, query
    assert {r.rowid // 40_000 for r in fuzzy.trigram_candidates_index(docs, blocks, "needle").collect()} == {0, 1, 2, 3}


def scanned(df):
    """Rows that the scans of an executed query put out."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            todo.append(node.children().apply(k))
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return out


def test_a_session_is_found_by_filters(spark, tmp_path):
    """A page of a session reads the row groups with its Bloom filter's bits only."""
    from threadloom.operators.detail import browse

    rows = [(n, f"s-{n * 7919 % 1000:03d}", f"/ws/{n // 250}", 1, k, "user/message", k, f"{n} {k} " + "word " * 40) for n in range(1000) for k in range(8)]
    store = IndexStore(spark, str(tmp_path / "index"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "100000")
    try:
        store.commit(docs=index.build_documents(spark.createDataFrame(rows, EVENTS)).coalesce(1))
    finally:
        hadoop.unset("parquet.block.size")
    page = browse(store.read("docs"), "s-500", 0, 5)
    assert [r.seq for r in page.collect()] == [0, 1, 2, 3, 4] and scanned(page) < 0.2 * len(rows)
    place = index.in_scope(store.read("docs"), cwd="/ws/2")
    assert len(place.collect()) == 2000 and scanned(place) < 0.5 * len(rows)
