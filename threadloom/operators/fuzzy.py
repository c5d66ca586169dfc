"""Fuzzy search: n-gram candidates, containment scores, one query or a table of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings, clamp_fuzzy
from ..functions.text import fold_ascii, ngram_list, strip_literal, strip_text
from .index import in_scope, rows_with_grams

QUERY_ROWS, TEXT_ROWS, FETCH_ROWS, HEAD_ROWS = 2000, 500, 1000, 5000
#: Grams of the queries that are counted together, and cells of their grams x queries matrix.
BLOCK_GRAMS, BLOCK_CELLS = 1 << 14, 1 << 23

_AZ = {c: c + 32 for c in range(65, 91)}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_AZ)


def trigram_match(norm: Column, query: str) -> Column:
    """Whether the whole stripped text holds one of the query's trigrams, in any case."""
    return _any([F.contains(F.lower(norm), F.lit(g.lower())) for g in ngram_list(strip_literal(query), 3)])


def like_hits(text: Column, query: str) -> Column:
    """How many of the query's bigrams the raw text holds, ignoring case of A-Z."""
    folded = fold_ascii(text)
    hits = [F.when(F.contains(folded, F.lit(_ascii(g))), 1).otherwise(0) for g in ngram_list(strip_literal(query), 2)]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def single_char_match(text: Column, query: str) -> Column:
    """For a query of one character: whether the raw text holds it."""
    q = strip_literal(query)
    return F.contains(fold_ascii(text), F.lit(_ascii(q))) if len(q) == 1 else F.lit(False)


def is_candidate(docs_text: Column, norm: Column, query: str) -> Column:
    """Union of the trigram, bigram and single-character passes, in one scan."""
    return trigram_match(norm, query) | (like_hits(docs_text, query) > 0) | single_char_match(docs_text, query)


def trigram_candidates(docs: DataFrame, query: str, cap: int | None = None) -> DataFrame:
    """Documents of the trigram pass; with ``cap`` only so many of the first ones."""
    found = docs.where(trigram_match(F.col("norm"), query))
    return found if cap is None else found.orderBy("rowid").limit(cap)


def trigram_candidates_index(docs: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
    """``trigram_candidates`` by the index of whole texts (see ``index.gram_blocks``).

    A gram that grows when it is lower-cased is looked up by its first three characters;
    what is found is compared again.
    """
    wanted = sorted({g.lower()[:3] for g in ngram_list(strip_literal(query), 3)})
    if not wanted:
        return docs.where("false")
    return docs.join(rows_with_grams(blocks, wanted), "rowid", "left_semi").where(trigram_match(F.col("norm"), query))


def bigram_candidates(docs: DataFrame, query: str, cap: int | None = None) -> DataFrame:
    """(rowid, like_hits) of the bigram pass; with ``cap`` only so many of those with most hits."""
    found = docs.withColumn("like_hits", like_hits(F.col("text"), query)).where("like_hits > 0").select("rowid", "like_hits")
    return found if cap is None else found.orderBy(F.desc("like_hits"), "rowid").limit(cap)


def fuzzy_score(norm: Column, query: str, s: Settings = SETTINGS) -> Column:
    """Share of the query's bigrams and trigrams in the stripped text's prefix.

    ``contains(prefix, gram)`` over distinct query grams counts the shared grams, so no
    gram set of the document is built.
    """
    q = strip_literal(query)
    prefix = F.substring(norm, 1, s.rerank_chars)
    if s.fold_case:
        prefix, q = F.lower(prefix), q.lower()
    if not q:
        return F.lit(0.0)
    if len(q) == 1:
        return F.when(F.contains(prefix, F.lit(q)), s.single_char_score).otherwise(0.0)

    def share(grams: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.contains(prefix, F.lit(g)), 1).otherwise(0) for g in grams]) / float(len(grams))

    score = share(ngram_list(q, 2)) * s.bigram_weight
    if len(q) >= 3:
        score = score + share(ngram_list(q, 3)) * s.trigram_weight
    return F.when(F.contains(prefix, F.lit(q)), F.greatest(score, F.lit(s.substring_floor))).otherwise(score)


def search(docs: DataFrame, query: str, limit: object = 20, session_id: str | None = None, cwd: str | None = None, min_score: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """The best hits of one query: the documents' columns and ``score``.

    One scan with the scope filter pushed down; only the top rows leave a task.
    """
    least = s.min_fuzzy_score if min_score is None else min_score
    found = in_scope(docs, session_id, cwd).where(is_candidate(F.col("text"), F.col("norm"), query)) if strip_literal(query) else docs.where("false")
    scored = found.withColumn("score", F.round(fuzzy_score(F.col("norm"), query, s), 6)).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "rowid").limit(clamp_fuzzy(limit))


def _in(column: str, values: list) -> Column:
    """``column`` is one of ``values``, in short lists, each of which a Parquet scan can skip by."""
    return _any([F.col(column).isin(values[k : k + 10]) for k in range(0, len(values), 10)])


def search_index(docs: DataFrame, postings: DataFrame, query: str, limit: object = 20, session_id: str | None = None, cwd: str | None = None, min_score: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """``search`` by way of postings (rowid, session_id, n, gram): the same hits.

    The query's grams are counted per document in the postings, of which the scan reads
    only their ranges. A document with a shared trigram is a candidate for sure, so the
    ``limit``-th of those sets a bar; only documents that reach it, or that may hold the
    whole query, are fetched and scored. Queries of one character, and scores without
    case, are not what the postings hold and go to ``search``.
    """
    least, most = s.min_fuzzy_score if min_score is None else min_score, clamp_fuzzy(limit)
    q = strip_literal(query)
    two, three = ngram_list(q, 2), ngram_list(q, 3)
    if not two or s.fold_case:
        return search(docs, query, limit, session_id, cwd, min_score, s)
    wanted = ((F.col("n") == 2) & _in("gram", two)) | ((F.col("n") == 3) & _in("gram", three))
    own = postings.where(wanted) if session_id is None else postings.where((F.col("session_id") == session_id) & wanted)
    share = s.bigram_weight * F.col("h2") / len(two) + (s.trigram_weight * F.col("h3") / len(three) if three else F.lit(0.0))
    counts = own.groupBy("rowid").agg(F.count_if(F.col("n") == 2).alias("h2"), F.count_if(F.col("n") == 3).alias("h3"))
    likely = counts.select("rowid", "h3", (F.col("h2") == len(two)).alias("full"), share.alias("base"))
    if cwd and not session_id:
        likely = likely.join(docs.where(F.col("cwd") == cwd).select("rowid"), "rowid", "left_semi")
    likely = likely.where((F.col("base") >= least - 1e-6) | F.col("full"))
    # the best of them come to the driver once; as a rule they tell the bar and what reaches it
    head = likely.orderBy(F.desc("full"), F.desc("base"), "rowid").limit(HEAD_ROWS).collect()
    sure = sorted((-r["base"], r["rowid"]) for r in head if r["h3"] > 0)[:most]
    bar = -sure[-1][0] if len(sure) == most else 0.0
    rows = [r["rowid"] for r in head if r["full"] or r["base"] >= bar - 1e-6]
    whole = len(head) < HEAD_ROWS or not head[-1]["full"] and head[-1]["base"] < bar - 1e-6
    if whole and len(rows) <= FETCH_ROWS:  # few enough to be named in the scan
        found = in_scope(docs, session_id, cwd).where(_in("rowid", sorted(rows)))
    else:
        best = likely.where("h3 > 0").orderBy(F.desc("base"), "rowid").limit(most)
        least_sure = best.agg(F.when(F.count("*") == most, F.min("base")).otherwise(0.0).alias("bar"))
        likely = likely.join(F.broadcast(least_sure)).where((F.col("base") >= F.col("bar") - 1e-6) | F.col("full"))  # bar is one row
        found = in_scope(docs, session_id, cwd).join(likely.select("rowid"), "rowid", "left_semi")
    scored = found.where(is_candidate(F.col("text"), F.col("norm"), query)).withColumn("score", F.round(fuzzy_score(F.col("norm"), query, s), 6))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "rowid").limit(most)


def query_parts(queries: DataFrame) -> DataFrame:
    """(qid, q) of stripped queries (qid, query) with at least two characters; qid is text or a number."""
    qid = F.col("qid") if dict(queries.dtypes)["qid"] == "string" else F.col("qid").cast("bigint").alias("qid")
    return queries.select(qid, strip_text(F.col("query")).alias("q")).where(F.length("q") >= 2)


def gram_blocks(queries: list[str]) -> list[tuple[int, int]]:
    """Ranges of consecutive queries whose matrices stay within ``BLOCK_GRAMS`` and ``BLOCK_CELLS``.

    A query with more grams than that is a range of its own: its matrix is one column.
    """
    out, begin, grams = [], 0, set()
    for k, q in enumerate(queries):
        own = {q[i : i + 3] for i in range(len(q) - 2)} | {q[i : i + 2] for i in range(len(q) - 1)}
        more = len(grams | own)
        if k > begin and (more > BLOCK_GRAMS or more * (k + 1 - begin) > BLOCK_CELLS):
            out.append((begin, k))
            begin, grams = k, set()
        grams |= own
    return [*out, (begin, len(queries))] if queries else []


class GramCounter:
    """How many of each query's distinct n-grams a text has, for a block of queries.

    The block's distinct grams are numbered; a text is a 0/1 row over them, and one
    product with the grams x queries matrix counts for all queries at once. Blocks are
    bounded by ``gram_blocks``, so neither the matrix nor the rows grow with the queries.
    """

    def __init__(self, queries: list[str], n: int):
        grams = [ngram_list(q, n) for q in queries]
        self.n, self.size = n, np.array([len(g) for g in grams])
        self.codes = np.unique(self._codes("".join(g for q in grams for g in q))[::n]) if any(grams) else np.zeros(0, np.uint64)
        self.matrix = np.zeros((len(self.codes), len(queries)), np.float32)
        for k, g in enumerate(grams):
            if g:
                self.matrix[np.searchsorted(self.codes, self._codes("".join(g))[::n]), k] = 1

    def _codes(self, text: str) -> np.ndarray:
        """One number per run of ``n`` characters."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        m = max(0, len(c) - self.n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out = out * np.uint64(1 << 21) + c[k : k + m]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts, queries) counts."""
        if not len(self.codes):
            return np.zeros((len(texts), len(self.size)), np.float32)
        rows = np.zeros((len(texts), len(self.codes)), np.float32)
        for row, text in zip(rows, texts):
            codes = self._codes(text)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            row[at[self.codes[at] == codes]] = 1
        return rows @ self.matrix


def _near(folded: str, lower: str, q: str) -> bool:
    """The candidate passes, for one pair: raw text with A-Z folded, stripped text lower-cased."""
    return any(g.lower() in lower for g in ngram_list(q, 3)) or any(_ascii(g) in folded for g in ngram_list(q, 2))


_COUNTS = "rowid bigint, h2 int, g2 int, h3 int, g3 int, whole boolean"


def _count_block(docs: DataFrame, block: list[tuple], kind: str, least: float, limit: int, s: Settings) -> DataFrame:
    """Counts of likely pairs; ``kind`` is the type of the block's ids.

    A task holds its best ``limit`` pairs per query, by score, then rowid, and gives them
    out at its end; what is below a query's bar is not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block)
    arrow = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qs = [k for k, _ in shared.value], [q for _, q in shared.value]
        blocks = [(a, b, GramCounter(qs[a:b], 2), GramCounter(qs[a:b], 3)) for a, b in gram_blocks(qs)]
        bar = np.full(len(qs), least)
        held = np.zeros((0, 6))  # query, rowid, h2, h3, whole, score
        fresh: list[np.ndarray] = []

        def pruned() -> np.ndarray:
            x = np.concatenate([held, *fresh])
            if not len(x):  # a task without a hit so far
                return x
            x = x[np.lexsort((x[:, 1], -x[:, 5], x[:, 0]))]
            first = np.searchsorted(x[:, 0], x[:, 0])
            x = x[np.arange(len(x)) - first < limit]
            last = np.flatnonzero(np.append(x[1:, 0] != x[:-1, 0], True))
            many = np.bincount(x[:, 0].astype(int), minlength=len(qs))[x[last, 0].astype(int)] == limit
            bar[x[last[many], 0].astype(int)] = x[last[many], 5]
            return x

        for batch in batches:
            for k in range(0, batch.num_rows, TEXT_ROWS):
                rows, texts, norms = (batch.column(c).slice(k, TEXT_ROWS).to_pylist() for c in range(3))
                prefixes = [n[: s.rerank_chars] for n in norms]
                lower, folded = [n.lower() for n in norms], [_ascii(t) for t in texts]
                for first, end, two, three in blocks:
                    h2, h3 = two.counts(prefixes), three.counts(prefixes)
                    base = s.bigram_weight * h2 / two.size + s.trigram_weight * h3 / np.maximum(three.size, 1)
                    full = h2 == two.size
                    at = np.argwhere(np.where(full, np.maximum(base, s.substring_floor), base) >= bar[first:end] - 1e-6)
                    at = [(i, j) for i, j in at.tolist() if h3[i, j] or _near(folded[i], lower[i], qs[first + j])]
                    if at:
                        i, j = (np.array(x) for x in zip(*at))
                        whole = np.array([bool(full[a, b]) and qs[first + b] in prefixes[a] for a, b in at])
                        score = np.round(np.where(whole, np.maximum(base[i, j], s.substring_floor), base[i, j]), 6)
                        fresh.append(np.stack([first + j, np.array(rows)[i], h2[i, j], h3[i, j], whole, score], axis=1)[score >= least])
                if sum(map(len, fresh)) > max(50_000, 2 * limit * len(qs)):
                    held, fresh = pruned(), []
        held = pruned()
        j = held[:, 0].astype(int)
        g2, g3 = (np.concatenate([np.zeros(0, int), *(b[k].size for b in blocks)]) for k in (2, 3))
        cols = [held[:, 1], held[:, 2], g2[j], held[:, 3], g3[j], held[:, 4]]
        kinds = [pa.int64()] + [pa.int32()] * 4 + [pa.bool_()]
        found = [pa.array(np.asarray(c).astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in j], arrow), *found], names=["qid", *(f.split()[0] for f in _COUNTS.split(", "))])

    return docs.select("rowid", "text", "norm").mapInArrow(run, f"qid {kind}, {_COUNTS}")


def search_many(docs: DataFrame, queries: DataFrame, limit: int = 20, min_score: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """The best hits of each query (qid, query): qid, rowid, score, rank.

    Queries are a stated set, taken in blocks of ``QUERY_ROWS``: a block goes to all
    tasks, which count shared grams in one matrix product per few documents and few queries, so neither grams nor texts are shuffled, only each task's best hits.
    Queries of one character have no grams and are left to ``search``.
    """
    least = s.min_fuzzy_score if min_score is None else min_score
    wanted = query_parts(queries)
    blocks = max(1, -(-wanted.count() // QUERY_ROWS))
    kind, hits = dict(wanted.dtypes)["qid"], None
    for b in range(blocks):
        block = [(r["qid"], r["q"]) for r in wanted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").collect()]
        part = _count_block(docs, block, kind, least, limit, s)
        hits = part if hits is None else hits.unionByName(part)
    base = s.bigram_weight * F.col("h2") / F.col("g2") + F.when(F.col("g3") > 0, s.trigram_weight * F.col("h3") / F.col("g3")).otherwise(0.0)
    score = F.round(F.when(F.col("whole"), F.greatest(base, F.lit(s.substring_floor))).otherwise(base), 6)
    scored = hits.select("qid", "rowid", score.alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)
