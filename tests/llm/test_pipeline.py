import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from threadloom.llm import chosen_path, components, decontamination, language_id, mixing, staging

DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_each_stage_on_odd_rows(spark, odd, odd_rows, tmp_path, stored):
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(P.STAGES)
    run = lambda name: stages[name](spark, odd, str(tmp_path))
    kept = run("language_id")
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {3, 4, 5, 6} & ids == set() and {1, 2, 7, 8} <= ids
    near = run("near_duplicates")
    assert near.columns == odd.columns
    left = [r.doc_id for r in near.collect()]
    assert len({1, 2} & set(left)) == 1 and left.count(9) == 2 and {3, 4, 5, 6, 10, 11} <= set(left) and len({7, 8} & set(left)) == 1
    clean = run("decontamination")
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} & {1, 2} == set()
    mixed = run("mixing")
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 4
    assert run("token_output").count() == len(odd_rows)


def test_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_other_splits_between_scans_change_nothing(spark, tmp_path, monkeypatch):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(300)]
    rows = [(i, f"the {texts[i % 240]}" if i % 5 else None, "en", f"s{i % 4}") for i in range(300)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(16).write.parquet(path)
    spark.createDataFrame([(1, " ".join(texts[7].split()[:20]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, stages = spark.read.parquet(path), P.STAGES[:-1]
    result = lambda: [sorted(map(str, stage(spark, docs, str(tmp_path)).collect())) for _, stage in stages]
    want = result()
    turns, plain = iter(range(10_000)), staging.staged

    def turning(*args):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", (2, 40, 5)[next(turns) % 3])
        return plain(*args)

    for module in (staging, chosen_path, components, decontamination, mixing):
        monkeypatch.setattr(module, "staged", turning)
    try:
        assert result() == want
        assert next(turns) > 10
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_staged_tables_go_with_their_stage(spark, empty, stored, tmp_path):
    docs = stored([(1, "a b c"), (2, "a b c")])
    inner = []

    def make():
        inner.append(staging.numbered(docs, "inner").inputFiles()[0])
        return docs

    out = staging.settled(spark, make, "outer")
    assert out.count() == 2 and os.path.exists(out.inputFiles()[0].removeprefix("file:")) and not os.path.exists(inner[0].removeprefix("file:"))


def test_settings_are_left_alone(spark, odd):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    language_id.identify(odd).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the synthetic tables")
def test_whole_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = P.run(spark, DIR)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    leaks = {r.doc_id for r in decontamination.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("contaminated").collect()}
    unknown = {r.doc_id for r in language_id.identify(docs).where("lang_pred = 'und'").collect()}
    assert ids and not ids & leaks and not ids & unknown
    starts = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
