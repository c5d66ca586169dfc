"""The batch search where tasks, queries or tables have nothing to find, and in bounded memory."""

import os
import random

import pytest

import __spark_entry__ as entry
from threadloom.functions.text import strip_literal
from threadloom.operators import fuzzy
from threadloom.plans.golden import evaluate_golden

DOCS = "rowid bigint, text string, norm string"
QUERIES = "qid bigint, query string"
GOLDEN = os.environ.get("THREADLOOM_GOLDEN", "")


def table(spark, texts, parts=1):
    return spark.createDataFrame([(k, t, strip_literal(t)) for k, t in enumerate(texts, 1)], DOCS).coalesce(1).repartition(parts, "rowid") if texts else spark.createDataFrame([], DOCS)


def found(docs, spark, queries, limit=20):
    return sorted((r.qid, r.rowid) for r in fuzzy.search_many(docs, spark.createDataFrame(queries, QUERIES), limit).collect())


def test_no_hits(spark):
    assert found(table(spark, ["abc def", "ghi"]), spark, [(1, "zzzz")]) == []


def test_a_task_without_hits(spark):
    docs = table(spark, ["abc def"] + ["xyz"] * 30, 7)
    assert found(docs, spark, [(1, "abcdef"), (2, "qqqq")]) == [(1, 1)]


def test_empty_table(spark):
    assert found(table(spark, []), spark, [(1, "abc")]) == []


def test_no_queries(spark):
    assert found(table(spark, ["abc"]), spark, []) == []
    assert found(table(spark, ["abc"]), spark, [(1, "a"), (2, None)]) == []


def test_blocks_do_not_matter(spark, monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcde ") for _ in range(80)) for _ in range(120)]
    queries = [(k, "".join(draw.choice("abcde") for _ in range(draw.choice([2, 5, 40])))) for k in range(60)]
    docs = table(spark, texts, 3)
    want = found(docs, spark, queries, 5)
    parts = [fuzzy.GramCounter, fuzzy.gram_blocks]
    assert parts[1]([q for _, q in queries]) == [(0, 60)]
    whole = fuzzy.gram_blocks
    many = {k: fuzzy.search_many(docs, spark.createDataFrame(queries[k : k + 7], QUERIES), 5) for k in range(0, 60, 7)}
    assert sorted((r.qid, r.rowid) for d in many.values() for r in d.collect()) == want
    monkeypatch.setattr(fuzzy, "BLOCK_GRAMS", 40)
    cut = whole([q for _, q in queries])
    assert len(cut) > 5 and [a for a, _ in cut[1:]] == [b for _, b in cut[:-1]] and (cut[0][0], cut[-1][1]) == (0, 60)


def test_ideographic_queries_stay_bounded():
    draw = random.Random(5)
    queries = ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(2000)]
    blocks = fuzzy.gram_blocks(queries)
    assert blocks[0][0] == 0 and blocks[-1][1] == 2000
    for a, b in (blocks[0], blocks[-1]):
        two, three = fuzzy.GramCounter(queries[a:b], 2), fuzzy.GramCounter(queries[a:b], 3)
        assert max(two.matrix.nbytes, three.matrix.nbytes) <= 4 * fuzzy.BLOCK_CELLS
        assert fuzzy.TEXT_ROWS * max(len(two.codes), len(three.codes)) <= fuzzy.TEXT_ROWS * fuzzy.BLOCK_GRAMS
        assert two.counts([queries[a]])[0, 0] == 199


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
def test_every_query_over_many_splits(spark):
    """Small splits leave tasks without rows and without hits."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for name, f in entry.queries().items():
            f(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.skipif(not os.path.isfile(GOLDEN), reason="THREADLOOM_GOLDEN names a golden set with published figures")
def test_published_figures(spark):
    rows = {r.variant: tuple(round(r[c], 3) for c in ("recall5", "mrr", "ndcg")) for r in evaluate_golden(spark, GOLDEN).collect()}
    assert rows == {"literal": (0.196, 0.217, 0.201), "fuzzy": (0.587, 0.652, 0.579)}
