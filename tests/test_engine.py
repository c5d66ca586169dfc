"""Requests, groups, detail, reconciliation, the store, streams."""

import json

import pytest

from threadloom import config
from threadloom.engine import Engine, Scope, render_text, resolve_scope
from threadloom.operators import anchors, detail, episodes, index
from threadloom.operators.semantic import HashingEmbedder, embed_documents
from threadloom.operators.store import IndexStore
from threadloom.sources import eventlog
from threadloom.sources.golden import round_trip

TEXTS = {
    "A": ["we need a device sync tool", "use a state machine for conflicts", "is a state machine too rigid", "state machines make conflicts explicit", "fine, state machine it is", "the port is 8321"],
    "B": ["the disk was full at night", "monitor the disk level", "clean the log first", "a state of things"],
    "C": ["weekend hike", "ok"],
}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rows = [(k, s, "/x" if s < "C" else "/y", 1000 + k, i + 1, "user/message" if i % 2 == 0 else "assistant/message", 5 * i, t) for k, s in enumerate(TEXTS) for i, t in enumerate(TEXTS[s])]
    rows.append((0, "A", "/x", 1000, 7, "tool/call", 99, "[tool:read] {}"))
    events = spark.createDataFrame(rows, "session_no bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string")
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    index.build_documents(events).write.parquet(path)
    titles = spark.createDataFrame([("A", "Sync tool")], "id string, title string")
    return spark.read.parquet(path), events, titles


@pytest.fixture(scope="module")
def engine(parts):
    return Engine(*parts)


@pytest.mark.parametrize("value,want", [(None, 10), (0, 1), (51, 50), (float("nan"), 10), ("7", 10), (3.9, 3), (True, 10)])
def test_limit_clamp(value, want):
    assert config.clamp_limit(value) == want


def test_other_clamps():
    assert [config.clamp_context(x) for x in (None, -1, 11)] == [3, 0, 10]
    assert [config.clamp_page(x) for x in (None, 0, 99)] == [20, 1, 50] and config.clamp_page(99, 100) == 99
    assert [config.clamp_fuzzy(x) for x in (None, 500)] == [20, 100]


def test_scopes():
    assert resolve_scope("all", "/w", "s", "/c") == Scope()
    assert resolve_scope("workspace", " /w ", "s", "/c") == Scope(cwd="/w")
    assert resolve_scope("workspace", None, "s", "/c") == Scope(cwd="/c")
    assert resolve_scope("session", "/w", "s", "/c") == resolve_scope(None, "/w", "s", "/c") == resolve_scope("odd", None, "s") == Scope("s")
    assert resolve_scope("session", "/w", None, "/c") == Scope(cwd="/w")
    assert resolve_scope() == Scope()


def test_recall(engine):
    r = engine.recall("state machine", scope="all")
    assert r.ok and r.total == len(r.groups) and r.groups[0]["session_id"] == "A" and r.groups[0]["title"] == "Sync tool"
    first = r.groups[0]
    assert first["events"][0]["start_seq"] == 2 and first["events"][0]["end_seq"] >= 5 and "state machine" in first["snippet"]
    assert [g["session_id"] for g in engine.recall("state machine", current_session="A").groups] == ["A"]
    assert engine.recall("state machine", scope="all", limit=1).total == 1
    text = render_text(r)
    assert text.startswith('Recall "state machine": ') and "- Sync tool (A, /x) — " in text


def test_guards(engine):
    assert engine.recall("  ").error == "query is required" and engine.recall("", detail={"sessionId": "A"}).error == "query is required"
    assert not engine.recall("x").ok
    assert engine.recall("x", detail={}).error == "detail.sessionId is required"
    assert render_text(engine.recall(" ")) == "Recall failed: query is required"
    assert engine.recall("?!", scope="all").total == 0


def test_falls_back_to_phrases(parts):
    docs, events, titles = parts

    class Broken(Engine):
        def hits(self, *a):
            raise RuntimeError("index is gone")

    r = Broken(docs, events, titles).recall("the disk", scope="all")
    assert r.ok and [g["session_id"] for g in r.groups] == ["B"]


def test_semantic_layer(spark, parts):
    docs, events, titles = parts
    vectors = embed_documents(docs, lambda: HashingEmbedder(64))
    full = Engine(docs, events, titles, vectors, HashingEmbedder(64))
    assert full._semantic("weekend hike", Scope(), 5) is not None
    half = Engine(docs, events, titles, vectors.where("rowid < 5"), HashingEmbedder(64))
    assert half._semantic("weekend hike", Scope(), 5) is None
    assert full.recall("weekend hike", scope="all").groups[0]["session_id"] == "C"


class Counted(HashingEmbedder):
    """Counts the texts that it is given; fails if told to."""

    def __init__(self, dim, broken=False):
        super().__init__(dim)
        self.seen, self.broken = 0, broken

    def embed(self, texts):
        if self.broken:
            raise RuntimeError("no model")
        self.seen += len(texts)
        return super().embed(texts)


def test_requests_and_ticks_warm_up(spark, parts, tmp_path):
    docs, events, titles = parts
    none = spark.createDataFrame([], "rowid bigint, vec array<float>")
    off = Engine(docs, events, titles, none, Counted(64))
    assert off.recall("weekend hike", scope="all").ok and off.vectors.count() == 0 and off.embedder.seen == 0
    fast = Engine(docs, events, titles, none, Counted(64), config.Settings(warmup="fast"))
    assert fast.recall("weekend hike", scope="all").groups[0]["session_id"] == "C" and fast.vectors.count() == docs.count()
    few = config.Settings(warmup="gentle", warmup_gentle=5)
    gentle = Engine(docs, events, titles, none, Counted(64), few)
    assert [gentle.warm() for _ in range(4)] == [5, 5, 2, 0] and gentle.vectors.is_cached
    broken = Engine(docs, events, titles, none, Counted(64, broken=True), config.Settings(warmup="fast"))
    assert broken.warm() == 0 and broken.recall("state machine", scope="all").groups[0]["session_id"] == "A"
    store = IndexStore(spark, str(tmp_path / "index"))
    store.commit(docs=docs, postings=index.postings(docs))
    kept = Engine.of(store, events, titles, Counted(64), few)
    assert kept.warm() == 5 and IndexStore(spark, store.path).read("vectors").count() == 5
    assert [g["session_id"] for g in kept.recall("state machine", scope="all").groups] == [g["session_id"] for g in Engine(docs, events, titles).recall("state machine", scope="all").groups]


def test_warm_up_timer(spark, parts, tmp_path):
    import time

    from threadloom.streaming.ingest import start_warmup

    none = spark.createDataFrame([], "rowid bigint, vec array<float>")
    engine = Engine(*parts, none, Counted(64), config.Settings(warmup="gentle", warmup_gentle=4))
    timer = start_warmup(spark, engine, str(tmp_path / "state"), 1)
    try:
        until = time.time() + 60
        while engine.embedder.seen < 12 and time.time() < until:
            time.sleep(0.2)
    finally:
        timer.stop()
    assert engine.embedder.seen == 12


def test_response_table(spark, engine):
    r = engine.recall("state machine", scope="all")
    row = r.to_table(spark).first()
    assert row.ok and row.total == r.total and row.groups[0].session_id == "A" and row.groups[0].events[0].start_seq == 2
    page = engine.recall("x", detail={"sessionId": "A", "browse": True, "pageSize": 2}).to_table(spark)
    assert page.schema == r.schema() and page.first().groups[0].next_from_seq == 3
    assert engine.recall(" ").to_table(spark).first().error == "query is required"


def test_anchor_setting(spark, parts):
    s = spark.createDataFrame([("A", 9, 1, 7, "sum")], "session_id string, at bigint, low bigint, high bigint, summary string")
    assert Engine(*parts).anchor_texts(s).count() == 1 and Engine(*parts, settings=config.Settings(anchor=False)).anchor_texts(s).count() == 0


def test_model_embedder(monkeypatch, tmp_path):
    import types

    import numpy as np

    from threadloom.operators.semantic import OnnxEmbedder

    class Session:
        def __init__(self, path, options):
            self.path = path

        def run(self, names, feeds):
            assert names == ["last_hidden_state"] and set(feeds) == {"input_ids", "attention_mask", "token_type_ids"}
            ids = feeds["input_ids"]
            return [np.stack([ids, 2 * ids, np.ones_like(ids)], axis=2).astype(np.float32)]

    monkeypatch.setitem(__import__("sys").modules, "onnxruntime", types.SimpleNamespace(SessionOptions=types.SimpleNamespace, InferenceSession=Session))
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {"a": 1, "b": 2, "<unk>": 7}, "unk_token": "<unk>", "max_input_chars_per_word": 3}}))
    e = OnnxEmbedder("m", str(tmp_path / "v.json"), 3)
    assert e.pieces.encode("a aaaa x") == [101, 1, 7, 7, 102]
    got = e.embed(["a", "b a"])
    for ids, row in zip(([101, 1, 102], [101, 2, 1, 102]), got):
        mean = np.array([[i, 2 * i, 1] for i in ids]).mean(axis=0)
        assert np.allclose(row, mean / np.linalg.norm(mean))


def test_model_is_loaded_once(spark, parts, tmp_path):
    from threadloom.operators.semantic import HashingEmbedder, LazyEmbedder, embed_documents

    loads = []

    def load(path, vocabulary, dim):
        loads.append((path, vocabulary))
        if "broken" in path:
            raise OSError("damaged model")
        return HashingEmbedder(dim)

    (tmp_path / "m.onnx").write_bytes(b"x")
    (tmp_path / "empty.onnx").write_bytes(b"")
    (tmp_path / "broken.onnx").write_bytes(b"x")
    model = LazyEmbedder([str(tmp_path / n) for n in ("no.onnx", "empty.onnx", "m.onnx")], "v", 8, load)
    assert model.available and not model.ready and not loads
    assert (model.embed(["a b"]) == model.embed(["a b"])).all() and model.ready and loads == [(str(tmp_path / "m.onnx"), "v")]
    model.dispose()
    model.dispose()
    assert not model.ready and model.embed([]).shape == (0, 8) and len(loads) == 2
    broken = LazyEmbedder([str(tmp_path / "broken.onnx")], "v", 8, load)
    for _ in range(3):
        with pytest.raises(OSError, match="damaged"):
            broken.embed(["a"])
    assert len(loads) == 3 and not broken.ready
    broken.dispose()
    with pytest.raises(OSError):
        broken.embed(["a"])
    assert len(loads) == 4
    missing = LazyEmbedder([str(tmp_path / "no.onnx")], "v", 8, load)
    with pytest.raises(FileNotFoundError):
        missing.embed(["a"])
    vectors = spark.createDataFrame([], "rowid bigint, vec array<float>")
    assert not missing.available and Engine(*parts, vectors=vectors, embedder=missing)._semantic("q", Scope(), 3) is None
    assert Engine(*parts, vectors=vectors, embedder=broken).recall("state machine", scope="all").ok
    docs = parts[0]
    want = {r.rowid: r.vec for r in embed_documents(docs, lambda: HashingEmbedder(8)).collect()}
    assert {r.rowid: r.vec for r in embed_documents(docs, lambda: LazyEmbedder(model.models, "v", 8, lambda p, v, d: HashingEmbedder(d))).collect()} == want


def test_detail(engine):
    page = engine.recall("x", detail={"sessionId": "A", "browse": True, "pageSize": 2}).groups[0]
    assert [c["seq"] for c in page["context"]] == [1, 2] and page["next_from_seq"] == 3 and page["context"][0]["time"] is None
    last = engine.recall("x", detail={"sessionId": "A", "browse": True, "fromSeq": 5, "pageSize": 2}).groups[0]
    assert last["next_from_seq"] == 7  # a full last page still names a next one
    around = engine.recall("x", detail={"sessionId": "A", "seq": 6, "before": 1, "after": 5}).groups[0]
    assert [(c["seq"], c["type"]) for c in around["context"]] == [(5, "user/message"), (6, "assistant/message"), (7, "tool/call")]
    assert engine.recall("x", detail={"sessionId": "A", "seq": 50}).groups[0]["context"] == []
    hits = engine.recall("state machine", detail={"sessionId": "A"}).groups[0]
    assert {c["seq"] for c in hits["context"]} >= {2, 3, 4, 5}
    assert "→ next page from seq 3" in render_text(engine.recall("x", detail={"sessionId": "A", "browse": True, "pageSize": 2}))


def test_browse_range_counts_seq_numbers(parts):
    rows = detail.browse_range(parts[1], "A", 6, 2).collect()
    assert [r.seq for r in rows] == [6, 7] and rows[0].next_from_seq == 8


def test_islands(spark):
    rows = [(i, "s", i * 10, f"t{i}", 0.5 + (i == 9) * 0.1) for i in (1, 4, 9, 15, 16, 30, 60)]
    hits = spark.createDataFrame(rows, "rowid bigint, session_id string, seq bigint, text string, score double")
    got = [(r.start_seq, r.end_seq, r.hit_count, r.snippet) for r in episodes.episodes(hits, "q").orderBy("episode").collect()]
    assert got == [(10, 90, 3, "t9"), (150, 160, 2, "t15"), (300, 300, 1, "t30")]


FULL = "id string, fingerprint string, revision string, max_seq bigint"


def test_reconcile_truth_table(spark):
    stored = spark.createDataFrame(
        [("rebuilt", None, "r1", 4), ("to_live", None, "r1", 4), ("grew", "f1", None, 4), ("to_disk", "f1", None, 4), ("meta", "f1", "r1", 4), ("same", "f1", None, 4), ("kept", None, "r1", 4), ("gone", "f1", None, 4)], FULL
    )
    live = spark.createDataFrame([("new", "f9"), ("to_live", "f9"), ("grew", "f9"), ("meta", "f1"), ("same", "f1")], "id string, fingerprint string")
    snaps = spark.createDataFrame([("rebuilt", "r2"), ("to_disk", "r2"), ("meta", "r2"), ("kept", "r1"), ("new_disk", "r1")], "id string, revision string")
    got = {r.id: (r.action, r.from_seq, r.fingerprint, r.revision) for r in index.reconcile_plan(stored, live, snaps).collect()}
    assert got == {
        "new": ("reindex", -1, "f9", None), "new_disk": ("reindex", -1, None, "r1"), "rebuilt": ("reindex", -1, None, "r2"), "to_live": ("reindex", 4, "f9", None),
        "grew": ("reindex", 4, "f9", None), "to_disk": ("reindex", 4, None, "r2"), "meta": ("meta", None, "f1", "r2"), "same": ("skip", None, "f1", None),
        "kept": ("skip", None, None, "r1"), "gone": ("removed", None, "f1", None),
    }
    assert [r.id for r in index.removed_sessions(stored, live, snaps).collect()] == ["gone"]


def test_reconcile_apply(spark):
    doc = "session_id string, seq bigint, text string"
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "old"), ("gone", 1, "z")], doc)
    now = spark.createDataFrame([("a", 1, "changed"), ("a", 2, "y"), ("a", 3, "new"), ("b", 1, "rebuilt"), ("b", 5, "more")], doc)
    plan = spark.createDataFrame([("a", "reindex", 2), ("b", "reindex", -1), ("gone", "removed", None)], "id string, action string, from_seq bigint")
    got = sorted(tuple(r) for r in index.reconcile_apply(old, now, plan).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "new"), ("b", 1, "rebuilt"), ("b", 5, "more")]


def test_fingerprints(spark):
    e = spark.createDataFrame([("a", 1, 10, "u"), ("a", 7, None, "v"), ("b", 3, 5, "w")], "session_id string, seq bigint, time bigint, type string")
    assert {r.id: r.fingerprint for r in index.fingerprints(e).collect()} == {"a": "2:7:undefined:v", "b": "1:3:5:w"}


def test_store(spark, parts, tmp_path):
    docs, events, _ = parts
    path = str(tmp_path / "index")
    store = IndexStore(spark, path)
    assert store.read("docs").count() == 0
    first = store.commit(docs=docs, postings=index.postings(docs))
    again = IndexStore(spark, path)
    assert again.version == first and again.read("docs").count() == docs.count() and again.read("postings").count() > 100
    second = again.commit(sessions=spark.createDataFrame([("A", "/x", 1, "f", None, 7)], "id string, cwd string, created_at bigint, fingerprint string, revision string, max_seq bigint"))
    assert IndexStore(spark, path).read("docs").count() == docs.count() and second != first
    again.clean()
    assert (tmp_path / "index" / first).exists()  # its tables are still read
    third = again.commit(docs=docs.limit(3), postings=index.postings(docs.limit(3)))
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(docs=docs)
    again.clean()
    assert (tmp_path / "index" / first).exists()  # it might be a commit under way
    again.clean(0)
    assert not (tmp_path / "index" / first).exists() and (tmp_path / "index" / second).exists()
    assert IndexStore(spark, path).version == third and IndexStore(spark, path).read("sessions").count() == 1
    newest = max((tmp_path / "index").glob("_meta-*.json"))
    (tmp_path / "index" / "_meta-000000000050.json").write_text(newest.read_text()[:20])  # a writer died here
    broken = IndexStore(spark, path)
    assert broken.version == third and broken.read("docs").count() == 3
    fourth = broken.commit(docs=docs)
    assert IndexStore(spark, path).version == fourth
    broken.close()
    broken.close()
    with pytest.raises(ValueError, match="closed"):
        broken.read("docs")
    (tmp_path / "index" / "_meta-000000000099.json").write_text(json.dumps({"application": "other", "schema": 2, "version": "v"}))
    with pytest.raises(ValueError):
        IndexStore(spark, path)


def test_default_path():
    from threadloom.operators.store import default_path

    assert default_path({"THREADLOOM_INDEX": "/a"}) == "/a" and default_path({"THREADLOOM_HOME": "/b"}) == "/b/index" and default_path({}).endswith("/.threadloom/index")


def test_event_log(spark, tmp_path):
    lines = [{"session_id": "a", "seq": 1, "type": "user/message", "time": 5, "data": {"content": " hi "}}, {"session_id": "a", "seq": 2, "type": "tool/call", "data": {"name": "x"}}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    log = eventlog.read_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 2
    assert [tuple(r) for r in eventlog.searchable(log).collect()] == [("a", 1, "user/message", 5, "hi")]
    assert eventlog.first_existing([str(tmp_path / "no"), str(tmp_path / "log.jsonl")]).endswith("log.jsonl") and eventlog.first_existing([]) is None


def test_golden(spark, parts):
    queries = spark.createDataFrame([(1, "state machine"), (2, "hike")], "qid bigint, query string")
    docs, asked = round_trip(parts[1], queries)
    assert docs.count() == 13 and {r.query for r in asked.collect()} == {"state machine", "hike"}


def test_golden_is_whole(spark):
    rows = [(n, str(n), "/w", n, seq, "user/message", seq, f"t {n}\n{seq}") for n in range(150) for seq in (0, 1, 2500)]
    events = spark.createDataFrame(rows, "session_no bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string")
    queries = spark.createDataFrame([(k, "q" * k) for k in range(150)], "qid bigint, query string")
    docs, asked = round_trip(events, queries)
    assert sorted(map(tuple, docs.select(*events.columns).collect())) == rows
    assert {(int(r.qid), r.query) for r in asked.collect()} == {(k, "q" * k) for k in range(150)}


def test_ingest_stream(spark, tmp_path):
    from threadloom.streaming.ingest import start_ingest

    logs = tmp_path / "logs"
    logs.mkdir()
    row = lambda i, t: json.dumps({"session_id": "a", "seq": i, "type": "user/message", "time": 1000 * i, "data": {"content": t}})
    (logs / "1.jsonl").write_text("\n".join([row(1, "one"), row(2, " "), row(2, "two")]))
    args = (str(tmp_path / "docs"), str(tmp_path / "state"))
    start_ingest(eventlog.stream_log(spark, str(logs)), *args).awaitTermination()
    (logs / "2.jsonl").write_text("\n".join([row(2, "two"), row(3, "three")]))
    start_ingest(eventlog.stream_log(spark, str(logs)), *args).awaitTermination()
    assert sorted((r.seq, r.norm) for r in spark.read.parquet(args[0]).collect()) == [(1, "one"), (2, "two"), (3, "three")]


def test_anchor_stream_equals_batch(spark):
    import random

    from threadloom.streaming.run import drain_anchors

    draw = random.Random(1)
    log = spark.createDataFrame([(str(draw.randrange(4)), i, draw.choice(["assembly"] * 6 + ["summary", "summary", "disposed"])) for i in range(300)], "session_id string, seq bigint, kind string")
    assert sorted(map(tuple, drain_anchors(spark, log).collect())) == sorted(map(tuple, anchors.active(log).collect()))


def test_anchor_text(spark, parts):
    s = spark.createDataFrame([("A", 9, 1, 7, "  " + "s" * 500), ("C", 9, 50, 60, None)], "session_id string, at bigint, low bigint, high bigint, summary string")
    got = {r.session_id: r.text.split("\n") for r in anchors.anchor_texts(s, parts[1]).collect()}
    assert got["A"][0] == anchors.SUMMARY + "s" * 400 and len(got["A"]) == 5 and got["A"][1].startswith(f"[{anchors.USER}#")
    assert got["C"] == [anchors.FOOTER]


def test_wordpiece(spark):
    from threadloom.operators.wordpiece import CLS, SEP, UNK, WordPiece, encode_texts

    w = WordPiece({"a": 1, "##b": 2, "漢": 3, "ab": 4})
    assert w.tokenize("ab aab 漢a x") == ["ab", "[UNK]", "漢", "a", "[UNK]"] and w.pieces("ab") == ["ab"] and w.pieces("a" * 101) == ["[UNK]"]
    assert w.encode("ab x") == [CLS, 4, UNK, SEP] and len(w.encode("a " * 900)) == 512 and w.encode(None) == [CLS, SEP]
    row = encode_texts(spark.createDataFrame([(1, "ab")], "rowid bigint, text string"), w.vocabulary).first()
    assert list(row.ids) == [CLS, 4, SEP] and list(row.mask) == [1, 1, 1]


def test_warm_up_and_keys(spark, parts):
    from threadloom.operators import semantic

    docs = parts[0]
    none = spark.createDataFrame([], "rowid bigint, vec array<float>")
    some = semantic.warm_up(docs, none, lambda: HashingEmbedder(8), 5)
    assert sorted(r.rowid for r in some.collect()) == [1, 2, 3, 4, 5]
    keyed = semantic.keyed_vectors(docs, some)
    assert sorted(r.rowid for r in semantic.attach(docs, keyed).collect()) == [1, 2, 3, 4, 5]
    changed = docs.selectExpr("rowid", "session_id", "seq", "if(rowid = 2, 'new text', text) AS text")
    assert sorted(r.rowid for r in semantic.attach(changed, keyed).collect()) == [1, 3, 4, 5]


def test_golden_variants(spark, tmp_path):
    from threadloom.plans.golden import evaluate_golden, report

    sessions = [{"id": s, "cwd": "/x", "createdAt": 1, "messages": [{"seq": i + 1, "type": "user/message", "time": i, "text": t} for i, t in enumerate(ts)]} for s, ts in TEXTS.items()]
    queries = [{"id": "q1", "q": "state machine", "relevant": ["A:2", "A:3", "A:4", "A:5"]}, {"id": "q2", "q": "disk level", "relevant": ["B:2"]}, {"id": "q3", "q": "zzzz", "relevant": []}]
    (tmp_path / "golden.json").write_text(json.dumps({"sessions": sessions, "queries": queries}, indent=1))
    got = {r.variant: r for r in evaluate_golden(spark, str(tmp_path / "golden.json"), lambda: HashingEmbedder(64)).collect()}
    assert set(got) == {"literal", "fuzzy", "semantic", "hybrid, gate, full", "hybrid, gate, half", "hybrid, no gate, half"}
    assert got["fuzzy"].recall5 == 1.0 and got["fuzzy"].queries == 2 and got["fuzzy"].false_positives == 0
    assert tuple(got["hybrid, gate, half"])[:5] == tuple(got["fuzzy"])[:5]
    lines = report(spark, str(tmp_path / "golden.json")).split("\n")
    assert lines[0].split() == ["variant", "recall5", "recall10", "mrr", "ndcg"] and lines[2].startswith("fuzzy") and "1.000" in lines[2]
    assert "q3 zzzz (negative) → (none)" in lines and lines[-1].endswith("0/1") and any(x.startswith("q1 state machine → a:") and x.endswith("4/4") for x in lines)
