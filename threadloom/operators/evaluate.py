"""Retrieval quality: recall, reciprocal rank, gain, false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_key(session_id: Column, seq: Column) -> Column:
    """``session:seq`` in lower case, as judgements name documents."""
    return F.lower(F.concat_ws(":", session_id, seq.cast("string")))


def metrics(ranked: DataFrame, judged: DataFrame, depth: int | None = None) -> DataFrame:
    """Per query with relevant documents: qid, recall5, recall10, mrr, ndcg.

    ``ranked`` has qid, key, rank; ``judged`` qid and relevant (array of keys). Gain and
    reciprocal rank look at the whole list unless ``depth`` says otherwise, the ideal
    gain at all relevant documents.
    """
    wanted = judged.where(F.size("relevant") > 0).select("qid", F.size(F.array_distinct("relevant")).alias("n"), F.explode(F.array_distinct(F.transform("relevant", F.lower))).alias("key"))
    if depth is not None:
        ranked = ranked.where(F.col("rank") <= depth)
    hits = wanted.join(ranked.select("qid", "key", "rank"), ["qid", "key"], "left")
    gain = F.sum(F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.max("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    found = lambda k: F.count(F.when(F.col("rank") <= k, 1)) / F.max("n")
    return hits.groupBy("qid").agg(
        F.round(found(5), 6).alias("recall5"), F.round(found(10), 6).alias("recall10"),
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.round(gain / ideal, 6).alias("ndcg"),
    )


def averages(per_query: DataFrame) -> DataFrame:
    """One row: means of the metrics and the number of queries; nulls are skipped."""
    names = ["recall5", "recall10", "mrr", "ndcg"]
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def false_positives(ranked: DataFrame, judged: DataFrame, top: int = 5) -> DataFrame:
    """One row: queries without relevant documents, and those of them with any hit at the top."""
    none = judged.where(F.size("relevant") == 0).select("qid")
    hit = none.join(ranked.where(F.col("rank") <= top).select("qid").distinct(), "qid", "left_semi")
    return none.agg(F.count("*").alias("negatives")).join(F.broadcast(hit.agg(F.count("*").alias("false_positives"))))
