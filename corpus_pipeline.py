"""Five training-data stages over ``documents``, each a table that the next one reads.

    language_id        drops documents in which no language is found
    near_duplicates    of each class of similar documents, keeps the one with most shingles
    decontamination    drops documents that hold a benchmark item
    mixing             repeats or drops documents so that sources meet their targets
    token_output       writes Simple-8b token files and returns what they hold
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chosen_path, decontamination, language_id, mixing, staging, token_output

#: A document goes if no language is that probable; true texts score far above.
MIN_SCORE = 0.5


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; the model learns from the labels not held out.

    Null, empty and letterless texts have none and go; null doc_ids, repeated rows and
    other columns of any names stay as they are; without any label all texts with a
    letter stay; an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model)
    ok = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE) if model.langs else F.col("doc.text").rlike(r"\p{L}")
    return found.where(ok).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class: the one with most shingles, then the smallest id.

    The winner of a class is an aggregate, so no class is gathered anywhere. Texts
    without words are a class each and stay; null doc_ids lose ties, and of equal rows
    the first stays; other columns of any names are kept; an empty table gives an empty one.
    """
    numbered = staging.numbered(docs, "pipeline-rows")
    found = staging.staged(chosen_path.similar_rows(numbered), "pipeline-classes")
    rank = F.struct("n_shingles", (-F.coalesce(F.col("doc_id"), F.lit(2**62))).alias("minus_id"), (-F.col("row")).alias("minus_row"))
    winners = found.groupBy("class_row").agg(F.max(rank).alias("best")).select((-F.col("best.minus_row")).alias("row"))
    losers = staging.staged(found.select("row").join(winners, "row", "left_anti"), "pipeline-losers")
    return numbered.join(F.broadcast(losers) if staging.can_broadcast(losers) else losers, "row", "left_anti").select("doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null, empty and wordless texts hold none and stay, so do null doc_ids, repeated rows
    and other columns of any names; without items all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean_documents(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words, and are taken only as often as their source's
    whole multiple; a null source is one of its own; null and repeated doc_ids are
    documents like others; other columns of any names are kept; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back.

    Null and empty texts have only the end id; null doc_ids come first; repeated rows
    follow each other; other columns are left out; an empty table gives an empty result.
    """
    return token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", find_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL has no tokenizer, walks or chosen paths; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last stored and read again.

    What a stage staged for itself goes when its result is stored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_NAME: dict[str, str] = {}
