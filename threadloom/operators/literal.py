"""Literal search: quoted phrases per session or event, and BM25 over words.

Each search has two forms with the same results: a scan of the documents' texts, and one
of the positional word index (``word_postings``), which reads the query's words only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_list, words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def phrase_count(text: Column, query: str) -> Column:
    """Occurrences of the query's words in a row, in order and next to each other."""
    wanted = "".join(f" {w} " for w in word_list(query))
    if not wanted:
        return F.lit(0).cast("bigint")
    padded = F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))
    return F.floor((F.length(padded) - F.length(F.replace(padded, F.lit(wanted), F.lit("")))) / len(wanted)).cast("bigint")


def search_events(docs: DataFrame, query: str, session_id: str | None = None, limit: int = 20) -> DataFrame:
    """Documents with the phrase, in order of rowid, all with score 1."""
    found = docs if session_id is None else docs.where(F.col("session_id") == session_id)
    found = found.withColumn("spans", phrase_count(F.col("text"), query)).where("spans > 0")
    return found.withColumn("score", F.lit(1.0)).orderBy("rowid").limit(limit)


def search_sessions(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Sessions by number of spans: session_id, cwd, created_at, spans, best_rowid.

    The best match is the document with most spans, the first of equals.
    """
    found = docs.withColumn("spans", phrase_count(F.col("text"), query)).where("spans > 0")
    best = F.max(F.struct("spans", (-F.col("rowid")).alias("minus"))).alias("best")
    per = found.groupBy("session_id").agg(F.first("cwd").alias("cwd"), F.first("created_at").alias("created_at"), F.sum("spans").alias("total"), best)
    out = per.select("session_id", "cwd", "created_at", F.col("total").alias("spans"), (-F.col("best.minus")).alias("best_rowid"))
    return out.orderBy(F.desc("spans"), "best_rowid").limit(limit)


def bm25(docs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Documents with any word of the query by BM25: rowid, session_id, seq, score.

    Corpus statistics (documents, mean length, document frequencies) are one row from a
    first aggregate over all documents, so the second scan needs no shuffle but its top
    rows; a query's words are few literals.
    """
    tokens = word_list(query)
    distinct = list(dict.fromkeys(tokens))
    if not tokens:
        return docs.where("false").select("rowid", "session_id", "seq", F.lit(0.0).alias("score"))
    lengths = docs.select("rowid", "session_id", "seq", words(F.col("text")).alias("w"))

    def frequency(word: str) -> Column:
        return F.size(F.filter("w", lambda x: x == F.lit(word)))

    tf = [frequency(t).alias(f"tf{i}") for i, t in enumerate(distinct)]
    counted = lengths.select("rowid", "session_id", "seq", F.size("w").alias("len"), *tf)
    df = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(distinct))]
    corpus = counted.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"), *df)
    both = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(distinct)))).join(F.broadcast(corpus))  # corpus is one row

    def part(i: int, times: int) -> Column:
        n, f = F.col("n_docs"), F.col(f"df{i}")
        raw = F.log((n - f + 0.5) / (f + 0.5))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        t = F.col(f"tf{i}")
        return times * idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))

    score = sum((part(i, tokens.count(t)) for i, t in enumerate(distinct)), F.lit(0.0))
    out = both.select("rowid", "session_id", "seq", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "rowid")
    return out if limit is None else out.limit(limit)


def word_postings(docs: DataFrame) -> DataFrame:
    """(word, rowid, session_id, seq, len, positions): where each word stands in each document.

    ``len`` is the document's number of words. Each document has also a row of the word
    '', without positions, so that the corpus' size and mean length are read from those alone.
    """
    listed = docs.select("rowid", "session_id", "seq", words(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    key = ["rowid", "session_id", "seq", "len"]
    placed = listed.select(*key, F.posexplode("w").alias("at", "word")).groupBy("word", *key).agg(F.array_sort(F.collect_list("at")).alias("positions"))
    whole = listed.select(F.lit("").alias("word"), *key, F.array().cast("array<int>").alias("positions"))
    names = ["word", "rowid", "session_id", "seq", "len", "positions"]
    return placed.select(*names).unionByName(whole.select(*names))


def _only(index: DataFrame, tokens: list[str]) -> DataFrame:
    """Rows of some words; the scan skips all other ranges of the index, which is sorted by word."""
    return index.where(F.col("word").isin(tokens))


def bm25_many(index: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, rowid, session_id, seq, score) of each query (qid, query) by the word index, at most ``limit`` each."""
    asked = queries.select("qid", F.explode(words(F.col("query"))).alias("word")).groupBy("qid", "word").agg(F.count("*").alias("times"))
    scored = _scored(index, index.join(asked, "word"), index.join(asked.select("word").distinct(), "word", "left_semi"), ["qid"])
    if limit is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def bm25_index(index: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``bm25`` by the word index: rowid, session_id, seq, score."""
    tokens = word_list(query)
    if not tokens:
        return index.where("false").select("rowid", "session_id", "seq", F.lit(0.0).alias("score"))
    own = _only(index, sorted(set(tokens)))
    times = sum((F.when(F.col("word") == t, tokens.count(t)).otherwise(0) for t in sorted(set(tokens))), F.lit(0))
    out = _scored(index, own.withColumn("times", times), own, []).orderBy(F.desc("score"), "rowid")
    return out if limit is None else out.limit(limit)


def _scored(index: DataFrame, matches: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """BM25 of ``matches`` (rows of the index, and times); ``own`` are the rows of all the words asked for."""
    corpus = _only(index, [""]).agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    frequency = own.groupBy("word").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    t = F.size("positions")
    part = F.col("times") * weight * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    both = matches.join(frequency, "word").join(F.broadcast(corpus))  # corpus is one row
    return both.groupBy(*keys, "rowid", "session_id", "seq").agg(F.round(F.sum(part), 6).alias("score"))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def phrase_rows(index: DataFrame, query: str) -> DataFrame:
    """(rowid, session_id, spans) of documents with the query's words in a row, from their positions.

    Spans are counted from left to right and do not overlap.
    """
    tokens = word_list(query)
    if not tokens:
        return index.where("false").select("rowid", "session_id", F.lit(0).cast("bigint").alias("spans"))
    distinct = sorted(set(tokens))
    held = [F.max(F.when(F.col("word") == t, F.col("positions"))).alias(f"p{k}") for k, t in enumerate(distinct)]
    per = _only(index, distinct).groupBy("rowid", "session_id").agg(*held).dropna(subset=[f"p{k}" for k in range(len(distinct))])
    starts = F.col(f"p{distinct.index(tokens[0])}")
    for j, t in enumerate(tokens[1:], 1):
        starts = F.array_intersect(starts, _moved(F.col(f"p{distinct.index(t)}"), j))
    begin = F.struct(F.lit(0).alias("free"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, x: F.when(x >= acc["free"], F.struct((x + len(tokens)).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    spans = F.aggregate(F.array_sort(starts), begin, step, lambda acc: acc["n"])
    return per.select("rowid", "session_id", spans.alias("spans")).where("spans > 0")


def search_events_index(docs: DataFrame, index: DataFrame, query: str, session_id: str | None = None, limit: int = 20) -> DataFrame:
    """``search_events`` by the word index: only documents that are returned are fetched."""
    own = index if session_id is None else index.where(F.col("session_id") == session_id)
    best = phrase_rows(own, query).orderBy("rowid").limit(limit)
    return docs.join(F.broadcast(best.select("rowid", "spans")), "rowid").withColumn("score", F.lit(1.0)).orderBy("rowid")


def search_sessions_index(docs: DataFrame, index: DataFrame, query: str, limit: int = 10, session_id: str | None = None, cwd: str | None = None) -> DataFrame:
    """``search_sessions`` by the word index, in a session or a workspace."""
    found = phrase_rows(index if session_id is None else index.where(F.col("session_id") == session_id), query)
    if cwd and not session_id:
        found = found.join(docs.where(F.col("cwd") == cwd).select("rowid"), "rowid", "left_semi")
    best = F.max(F.struct("spans", (-F.col("rowid")).alias("minus"))).alias("best")
    per = found.groupBy("session_id").agg(F.sum("spans").alias("spans"), best).withColumn("best_rowid", -F.col("best.minus"))
    top = per.orderBy(F.desc("spans"), "best_rowid").limit(limit).select("spans", "best_rowid")
    named = docs.select(F.col("rowid").alias("best_rowid"), "session_id", "cwd", "created_at").join(F.broadcast(top), "best_rowid")
    return named.select("session_id", "cwd", "created_at", "spans", "best_rowid").orderBy(F.desc("spans"), "best_rowid")


def idf(n: int, df: int) -> float:
    """Inverse document frequency with its floor."""
    raw = math.log((n - df + 0.5) / (df + 0.5))
    return raw if raw > 0 else LEAST_IDF
