"""Candidates and scores against brute force, and the merging of layers."""

import random

import pytest

from threadloom.config import Settings
from threadloom.functions.text import ngram_list, strip_literal
from threadloom.operators import evaluate, fuzzy, hybrid, literal, semantic
from threadloom.operators.index import in_scope, number_documents, postings, searchable
from threadloom.operators.store import IndexStore

ALPHABET = list("abcABC 1-") + ["状", "态", "机", "é", "É", "ß", ".", "\n"]


def ascii_low(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def plain_score(text, query):
    q, prefix = strip_literal(query), strip_literal(text)[:1000]
    if not q:
        return None
    two, three = ngram_list(q, 2), ngram_list(q, 3)
    if len(q) == 1:
        return (0.8 if q in prefix else 0.0) if ascii_low(q) in ascii_low(text) else None
    low = strip_literal(text).lower()
    if not any(g.lower() in low for g in three) and not any(ascii_low(g) in ascii_low(text) for g in two):
        return None
    score = 0.7 * sum(g in prefix for g in two) / len(two)
    if three:
        score += 0.3 * sum(g in prefix for g in three) / len(three)
    return max(score, 0.9) if q in prefix else score


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(9)
    rows = [(i // 10, str(i // 10), f"/ws/{i // 10 % 2}", 1000, i % 10, "user/message", i, "".join(draw.choice(ALPHABET) for _ in range(draw.choice([2, 8, 30, 1500])))) for i in range(200)]
    events = spark.createDataFrame(rows, "session_no bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string")
    docs = number_documents(searchable(events))
    return docs, {r.rowid: r.text for r in docs.collect()}


QUERIES = ["abc", "a-b", "AbC1", "状态机", "é", "ab", "a", "Éa1", "-.", "bc状", "abcABC1状态机ca"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_brute_force(corpus, query):
    docs, texts = corpus
    want = sorted(((-round(s, 6), i) for i, t in texts.items() if (s := plain_score(t, query)) is not None and round(s, 6) >= 0.15))[:100]
    got = [(-r.score, r.rowid) for r in fuzzy.search(docs, query, 100).collect()]
    assert sorted(got) == want


@pytest.fixture(scope="module")
def stored_index(spark, corpus, tmp_path_factory):
    store = IndexStore(spark, str(tmp_path_factory.mktemp("store") / "index"))
    store.commit(docs=corpus[0])
    store.commit(postings=postings(store.read("docs")))
    return store


@pytest.mark.parametrize("head, fetch", [(1, 1000), (7, 1000), (5000, 3)])
def test_search_by_postings_beyond_the_head(stored_index, monkeypatch, head, fetch):
    """The same hits where the candidates do not fit into what comes to the driver."""
    monkeypatch.setattr(fuzzy, "HEAD_ROWS", head)
    monkeypatch.setattr(fuzzy, "FETCH_ROWS", fetch)
    docs, grams = stored_index.read("docs"), stored_index.read("postings")
    for query in ("abcABC1状态机ca", "ab", "状态机", "zzzz"):
        for limit in (2, 30):
            assert fuzzy.search_index(docs, grams, query, limit).collect() == fuzzy.search(docs, query, limit).collect()


@pytest.mark.parametrize("query", [*QUERIES, "abcab", "ca", "", "zzzz"])
@pytest.mark.parametrize("scope", [{}, {"session_id": "3"}, {"cwd": "/ws/1"}])
def test_search_by_postings_equals_scan(stored_index, query, scope):
    docs, grams = stored_index.read("docs"), stored_index.read("postings")
    for limit in (1, 7, 100):
        got, want = fuzzy.search_index(docs, grams, query, limit, **scope), fuzzy.search(docs, query, limit, **scope)
        assert got.columns == want.columns and [(r.rowid, r.score) for r in got.collect()] == [(r.rowid, r.score) for r in want.collect()]


def test_search_by_postings_reads_only_its_grams(stored_index, monkeypatch):
    docs, grams = stored_index.read("docs"), stored_index.read("postings")
    plan = fuzzy.search_index(docs, grams, "abc", 5)._jdf.queryExecution().toString()
    assert "In(rowid" in plan and "postings" not in plan  # the second scan names its rows
    monkeypatch.setattr(fuzzy, "FETCH_ROWS", 2)
    found = fuzzy.search_index(docs, grams, "abc", 5)
    assert "In(gram" in found._jdf.queryExecution().toString()
    assert [(r.rowid, r.score) for r in found.collect()] == [(r.rowid, r.score) for r in fuzzy.search(docs, "abc", 5).collect()]


def test_running_top_lists(corpus, spark):
    docs, _ = corpus
    some = spark.createDataFrame([(k, q) for k, q in enumerate(QUERIES) if len(strip_literal(q)) >= 2], "qid bigint, query string")
    best = fuzzy.search_many(docs.repartition(1), some, 3)
    assert sorted(map(tuple, best.collect())) == sorted(tuple(r) for r in fuzzy.search_many(docs, some, 50).where("rank <= 3").collect())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.6, 0.8]), (5, [1.0, 0.0, 0.0]), (6, [0.8, 0.6])]
    vectors = spark.createDataFrame(rows, "rowid bigint, vec array<double>").repartition(1)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None), (13, [1.0])], "qid bigint, vec array<double>")
    got = sorted((r.qid, r["rank"], r.rowid, r.score) for r in semantic.search_many(vectors, queries, 2, 0.5).collect())
    assert got == [(10, 1, 1, 1.0), (10, 2, 6, 0.8), (11, 1, 4, 0.8), (11, 2, 6, 0.6)]
    assert semantic.search_many(vectors, queries.where("false"), 2).count() == 0


def test_candidate_caps(corpus):
    docs, _ = corpus
    every = [(r.rowid, r.like_hits) for r in fuzzy.bigram_candidates(docs, "abc").collect()]
    assert [tuple(r) for r in fuzzy.bigram_candidates(docs, "abc", 5).collect()] == sorted(every, key=lambda x: (-x[1], x[0]))[:5]
    ids = sorted(r.rowid for r in fuzzy.trigram_candidates(docs, "abc").collect())
    assert [r.rowid for r in fuzzy.trigram_candidates(docs, "abc", 4).collect()] == ids[:4]


def test_many_queries_equal_single_ones(spark, corpus):
    docs, _ = corpus
    some = [(k, q) for k, q in enumerate(QUERIES) if len(strip_literal(q)) >= 2]
    got = sorted((r.qid, r.rowid, r.score) for r in fuzzy.search_many(docs, spark.createDataFrame(some, "qid bigint, query string"), 50).collect())
    want = sorted((k, r.rowid, r.score) for k, q in some for r in fuzzy.search(docs, q, 50).collect())
    assert got == want


def test_case_is_kept_in_scores_unless_folded(spark):
    docs = spark.createDataFrame([(1, "CPU load", "CPUload")], "rowid bigint, text string, norm string")
    assert fuzzy.search(docs, "cpu").count() == 0
    assert fuzzy.search(docs, "cpu", s=Settings(fold_case=True)).first().score == 1.0


def test_scope(corpus):
    docs, _ = corpus
    assert {r.session_id for r in in_scope(docs, session_id="3", cwd="/ws/0").collect()} == {"3"}
    assert {r.cwd for r in in_scope(docs, cwd="/ws/0").collect()} == {"/ws/0"}


def test_rowids_are_dense_and_ordered(corpus):
    docs, texts = corpus
    rows = sorted(docs.select("rowid", "session_no", "seq").collect())
    assert [r.rowid for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.session_no, r.seq) for r in rows] == sorted((r.session_no, r.seq) for r in rows)


def test_rowids_of_long_sessions(spark):
    from pyspark.sql import functions as F

    docs = spark.range(5000).select((F.col("id") % 3 * 5000).alias("session_no"), (F.col("id") * 7 % 5000).alias("seq"))
    rows = sorted(number_documents(docs).collect(), key=lambda r: (r.session_no, r.seq))
    assert [r.rowid for r in rows] == list(range(1, 5001))


def test_merge(spark):
    hits = "rowid bigint, session_id string, score double"
    f = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.4)], hits)
    s = spark.createDataFrame([(2, "a", 0.6), (3, "a", 0.55)], hits)
    got = [(r.rowid, r.score) for r in hybrid.merge(s, f, 10).collect()]
    assert got == [(1, 0.9), (2, 0.6), (3, 0.55)]
    assert [r.rowid for r in hybrid.merge(s, f, 1).collect()] == [1, 2]


def test_gate(spark):
    s = spark.createDataFrame([(1, 0.9)], "rowid bigint, score double")
    docs = spark.range(1, 11).withColumnRenamed("id", "rowid")
    for n, want in ((9, 1), (8, 0)):
        assert hybrid.gated(s, semantic.coverage(docs, docs.limit(n))).count() == want
    assert semantic.coverage(docs.where("false"), docs).first().coverage == 1.0
    orphan = spark.range(50, 90).withColumnRenamed("id", "rowid")  # vectors without a document do not count
    assert semantic.coverage(docs, orphan).first().coverage == 0.0


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rowid bigint, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (9, [1.0, 0.0]), (3, [1.0])], "rowid bigint, vec array<float>")
    assert [(r.rowid, r.score) for r in semantic.search(v, docs, [1.0, 0.0], dim=2).collect()] == [(1, 1.0), (2, 0.6)]
    assert semantic.search(v, docs, [1.0], dim=2).count() == 0
    assert [r.rowid for r in semantic.pending(docs, v.where("rowid = 1")).collect()] == [2, 3]
    stored = semantic.store(v, spark.createDataFrame([(2, [0.0, 1.0])], "rowid bigint, vec array<float>"))
    assert {r.rowid: list(r.vec) for r in stored.collect()}[2] == [0.0, 1.0] and stored.count() == 4


def test_pooling():
    import numpy as np

    h, m = np.random.default_rng(0).normal(size=(3, 4, 5)), np.array([[1, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]])
    p = semantic.pool(h, m)
    mean = h[0, :2].mean(axis=0)
    assert np.allclose(p[0], mean / np.linalg.norm(mean)) and (p[1] == 0).all() and np.isclose(np.linalg.norm(p[2]), 1)


def test_embedding_in_tasks(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(40)], "rowid bigint, text string")
    rows = semantic.embed_documents(docs, lambda: semantic.HashingEmbedder(16)).collect()
    by = {r.rowid: list(r.vec) for r in rows}
    assert len(by) == 40 and by[0] == by[3] != by[1]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "s", "w", 1, "of the of the, Of THE"), (2, "s", "w", 1, "often theory"), (3, "t", "w", 1, "öf the")], "rowid bigint, session_id string, cwd string, created_at bigint, text string")
    assert [(r.session_id, r.spans, r.best_rowid) for r in literal.search_sessions(docs, "of the").collect()] == [("s", 3, 1), ("t", 1, 3)]
    assert [r.rowid for r in literal.search_events(docs, "of the", "s").collect()] == [1]
    assert literal.search_sessions(docs, "...").count() == 0


def test_bm25(spark):
    import math

    texts = ["a b a", "b c", "d e f g", "a d"]
    docs = spark.createDataFrame([(i, "s", i, t) for i, t in enumerate(texts)], "rowid bigint, session_id string, seq bigint, text string")
    got = {r.rowid: r.score for r in literal.bm25(docs, "a zz a c").collect()}
    mean = sum(len(t.split()) for t in texts) / 4

    def part(t, w):
        n = sum(w in x.split() for x in texts)
        idf = math.log((4 - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        tf = t.split().count(w)
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / mean))

    want = {i: round(2 * part(t, "a") + part(t, "c"), 6) for i, t in enumerate(texts) if {"a", "c"} & set(t.split())}
    assert got == pytest.approx(want)
    assert literal.bm25(docs, " . ").count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "s:1", 1), ("q", "s:9", 2), ("q", "S:2".lower(), 3), ("n", "s:1", 4)], "qid string, key string, rank int")
    judged = spark.createDataFrame([("q", ["s:2", "S:3"]), ("n", []), ("m", ["s:7"])], "qid string, relevant array<string>")
    got = {r.qid: r for r in evaluate.metrics(ranked, judged).collect()}
    assert (got["q"].recall5, got["q"].mrr) == (0.5, 0.333333) and got["q"].ndcg == pytest.approx(0.5 / (1 + 0.63093), abs=1e-4)
    assert got["m"].mrr == 0 and "n" not in got
    assert evaluate.averages(evaluate.metrics(ranked, judged)).first().recall5 == 0.25
    assert tuple(evaluate.false_positives(ranked, judged).first()) == (1, 1)
