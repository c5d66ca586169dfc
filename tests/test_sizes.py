"""Work that must not grow faster than its input: what is built, sorted, written and cleaned, and how often."""

import glob

import pytest
from pyspark.sql import functions as F

from jobs import ingest_sessions
from threadloom.functions import text as T
from threadloom.operators import index, store, wordpiece
from threadloom.plans import built, registry

DIR = "/root/testdata/sf0.001"


def test_pieces_of_a_word_are_found_once(monkeypatch):
    model, asked = wordpiece.WordPiece({"[UNK]": 100, "ab": 1, "##c": 2}), []
    pieces = model.pieces
    monkeypatch.setattr(model, "pieces", lambda w: asked.append(w) or pieces(w))
    assert model.tokenize("abc ab abc x abc" + " " + "a" * 101) == ["ab", "##c", "ab", "ab", "##c", "[UNK]", "ab", "##c", "[UNK]"]
    assert asked == ["abc", "ab", "x"]
    assert model.ids(["ab", "##c", "[UNK]"], 4) == [101, 1, 2, 102]


def test_words_of_odd_characters():
    assert wordpiece.split_words("a\x00b\u4e2dc\ufeffd\u2028e-\x85f\ufffd\U0001f600\u3000¡g") == ["ab", "中", "c", "d", "e", "-", "f\U0001f600", "¡", "g"]


def test_queries_on_documents_build_documents_only(spark, monkeypatch):
    monkeypatch.setattr(built, "_BUILT", {})
    for name in ("browse_page", "vector_coverage", "warmup_batch", "encode"):
        registry.QUERIES[name](spark, DIR).collect()
    (made,) = built._BUILT.values()
    assert made.holds("docs") and not any(made.holds(t) for t in ("postings", "words", "grams", "sessions"))
    registry.QUERIES["fuzzy_search"](spark, DIR).collect()
    assert made.holds("postings") and not made.holds("grams")


def test_filter_of_documents_cleans_no_texts(spark):
    events = spark.createDataFrame([("user/message", t) for t in ("  a!", "…", None, "", "\x85 x \x85")], "type string, text string")
    plan = index.searchable(events).select("type")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert sorted(map(tuple, index.searchable(events).select("text", "norm").collect())) == [("a!", "a"), ("\x85 x \x85", "x")]


@pytest.mark.parametrize("raw, want", [("\u3000\ufeff a\u2028b \x0b", "a\u2028b"), ("a \x85", "a \x85"), (" \t", ""), (None, None)])
def test_trim_takes_white_space_at_the_very_ends_only(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.js_trim(F.col("t"))).first()[0] == want


def test_many_documents_are_sorted_in_more_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "DOCUMENTS_PER_PART", 10)
    docs = index.build_documents(spark.range(120).selectExpr("id session_no", "string(id) session_id", "'w' cwd", "0L created_at", "0L seq", "'user/message' type", "0L time", "concat('text ', id) text"))
    made = store.IndexStore(spark, str(tmp_path / "s"))
    made.commit(docs=docs)
    made.commit(postings=index.postings(made.read("docs")))
    assert len(glob.glob(f"{made._folders('postings')[0]}/*.parquet")) == 12
    assert made.read("postings").count() == index.postings(docs).count()


def test_the_streamed_log_is_written_by_all_tasks(spark, monkeypatch):
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "coalesce", lambda *_: pytest.fail("one task writes a whole log"))
    assert registry.QUERIES["idx_stream_index"](spark, DIR).count() > 0


def _turns(spark, path, first):
    rows = spark.range(first, first + 60).selectExpr("id conv_id", "explode(sequence(0L, 2L)) turn", "'user' role", "concat('text ', id) text")
    rows.write.mode("append").parquet(path)


@pytest.mark.parametrize("named", [1000, 1])
def test_a_small_month_is_one_file_a_batch(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(ingest_sessions, "NAMED", named)
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    for first in (0, 50):  # the second lot has ten sessions again
        _turns(spark, source, first)
        ingest_sessions.run(spark, source, output, str(tmp_path / "mark"))
    assert ingest_sessions.read_messages(spark, output).groupBy("session_id", "seq").count().where("count = 1").count() == 110 * 3
    assert ingest_sessions.read_sessions(spark, output).agg(F.sum("n_messages")).first()[0] == 110 * 3
    folders = glob.glob(f"{output}/messages/month=*/batch=*")
    assert len(folders) > 3 and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)
