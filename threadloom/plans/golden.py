"""Running a golden set through the layers and their mixes.

A golden set is small and hand-made, so its queries are driven one plan per layer: all
queries of a layer are ranked in one DataFrame (qid, key, rank), and all variants are
averaged together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..engine import QUERY_PREFIX
from ..operators import evaluate, fuzzy, index, literal, semantic
from ..sources.eventlog import read_golden

TOP = 10


def _ranked(hits: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """qid, key, rank of (qid, rowid, score)."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))
    named = hits.withColumn("rank", rank).join(docs.select("rowid", "session_id", "seq"), "rowid")
    named = named if limit is None else named.where(F.col("rank") <= limit)
    return named.select("qid", evaluate.rank_key(F.col("session_id"), F.col("seq")).alias("key"), "rank")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The better score of each (qid, rowid)."""
    columns = ["qid", "rowid", "score"]
    return a.select(*columns).unionByName(b.select(*columns)).groupBy("qid", "rowid").agg(F.max("score").alias("score"))


def rank_variants(spark: SparkSession, path: str, make_embedder: Callable[[], semantic.Embedder] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(ranked hits by variant, judged queries) of a golden set.

    Variants are literal and fuzzy; with an embedder also semantic and hybrid: behind the
    gate with all or the first half of the documents embedded, and without the gate.
    """
    raw, judged = read_golden(spark, path)
    docs = index.build_documents(raw).cache()
    asked = [(r["qid"], r["query"]) for r in judged.select("qid", "query").orderBy("qid").collect()]
    found = {"literal": _ranked(literal.bm25_many(literal.word_postings(docs), judged.select("qid", "query")).select("qid", "rowid", "score"), docs)}
    near = fuzzy.search_many(docs, judged.select("qid", "query"), 2 * TOP).select("qid", "rowid", "score")
    found["fuzzy"] = _ranked(near, docs)
    if make_embedder is not None:
        vectors = semantic.embed_documents(docs, make_embedder).cache()
        half = vectors.where(F.col("rowid") <= docs.count() // 2)
        made = make_embedder().embed([QUERY_PREFIX + q for _, q in asked])
        numbered = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(made)], "qid bigint, vec array<double>")
        names = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(asked)], "n bigint, qid string")

        def search(v: DataFrame) -> DataFrame:
            hits = semantic.search_many(v, numbered, 2 * TOP).withColumnRenamed("qid", "n")
            return hits.join(F.broadcast(names), "n").select("qid", "rowid", "score")

        def gated(v: DataFrame) -> DataFrame:
            ready = semantic.coverage(docs, v).first()["coverage"] >= SETTINGS.ready_coverage
            return _merged(search(v), near) if ready else near

        found["semantic"] = _ranked(search(vectors), docs)
        found["hybrid, gate, full"] = _ranked(gated(vectors), docs, 2 * TOP)
        found["hybrid, gate, half"] = _ranked(gated(half), docs, 2 * TOP)
        found["hybrid, no gate, half"] = _ranked(_merged(search(half), near), docs, 2 * TOP)
    return found, judged


def _averaged(found: dict[str, DataFrame], judged: DataFrame) -> DataFrame:
    rows = [
        evaluate.averages(evaluate.metrics(r, judged)).join(F.broadcast(evaluate.false_positives(r, judged))).withColumn("variant", F.lit(name))
        for name, r in found.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def evaluate_golden(spark: SparkSession, path: str, make_embedder: Callable[[], semantic.Embedder] | None = None) -> DataFrame:
    """variant, queries, recall5, recall10, mrr, ndcg, negatives, false_positives (see ``rank_variants``)."""
    return _averaged(*rank_variants(spark, path, make_embedder))


def report(spark: SparkSession, path: str, make_embedder: Callable[[], semantic.Embedder] | None = None, top: int = 5) -> str:
    """The evaluation as text: a row of metrics per variant, then what the best layer found for each query."""
    found, judged = rank_variants(spark, path, make_embedder)
    rows = {r["variant"]: r for r in _averaged(found, judged).collect()}
    names = ["recall5", "recall10", "mrr", "ndcg"]
    lines = ["variant".ljust(28) + "".join(n.rjust(10) for n in names)]
    for name in found:
        cells = ["-" if rows[name][n] is None else f"{rows[name][n]:.3f}" for n in names]
        lines.append(name.ljust(28) + "".join(c.rjust(10) for c in cells))
    primary = "hybrid, gate, full" if "hybrid, gate, full" in found else "fuzzy"
    hits = found[primary].where(F.col("rank") <= top).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("top"))
    lines += ["", f"queries ({primary})"]
    for r in judged.join(hits, "qid", "left").orderBy("qid").collect():  # a golden set is small and hand-made
        listed, wanted = r["top"] or [], {k.lower() for k in r["relevant"] or ()}
        if wanted:
            lines.append(f"{r['qid']} {r['query']} → {', '.join(listed) or '(no hits)'} · {len(wanted & set(listed))}/{len(wanted)}")
        else:
            lines.append(f"{r['qid']} {r['query']} (negative) → {listed[0] if listed else '(none)'}")
    one = rows[primary]
    lines += ["", f"negative queries with a hit among the first {top}: {one['false_positives']}/{one['negatives']}"]
    return "\n".join(lines)
