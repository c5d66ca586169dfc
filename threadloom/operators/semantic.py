"""Vectors: exact cosine search, coverage, warm-up, pooling, embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import ClassVar, Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..sources.eventlog import first_existing
from .index import text_hash, upsert

QUERY_ROWS, TEXT_ROWS = 4096, 1000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def search(vectors: DataFrame, docs: DataFrame, query: list[float], limit: int = 20, min_score: float = SETTINGS.min_semantic_score, dim: int | None = None, whole: bool = False) -> DataFrame:
    """Documents by cosine with a unit query vector: the documents' columns and ``score``.

    ``docs`` may be filtered to a scope beforehand: only its vectors are scored. Vectors
    without a document do not count, null ones and wrong dimensions give nothing. ``whole`` says
    that ``docs`` has the documents of all vectors, so that these need not be compared first.
    """
    dim = dim or SETTINGS.vector_dim
    if len(query) != dim:
        return docs.withColumn("score", F.lit(0.0)).where("false")
    q = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.where(F.size("vec") == dim)
    own = own if whole else own.join(docs.select("rowid"), "rowid", "left_semi")
    best = own.select("rowid", F.round(dot(F.col("vec"), q), 4).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "rowid").limit(limit)
    # texts are fetched for the best only
    return docs.join(F.broadcast(best), "rowid").select(*docs.columns, "score").orderBy(F.desc("score"), "rowid")


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, min_score: float = SETTINGS.min_semantic_score) -> DataFrame:
    """The best ``k`` vectors of each query: qid, rowid, score, rank.

    Queries (qid, vec) are a stated set, taken in blocks of ``QUERY_ROWS``; a block's
    matrix meets each task's vectors in products and only the task's best ``k`` per
    query are shuffled. Vectors that are null or of another length than the queries' are
    passed over, as are queries of another length than most.
    """
    queries = queries.where("vec is not null and size(vec) > 0")
    sizes = queries.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    queries = queries.where(F.size("vec") == dim)
    vectors = vectors.where(F.size("vec") == dim)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_ROWS))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vec").orderBy("qid").collect()
        if rows:
            part = _best(vectors, [r["qid"] for r in rows], np.array([r["vec"] for r in rows], np.float64), k, min_score)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "qid bigint, rowid bigint, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rowid"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(vectors: DataFrame, qids: list[int], matrix: np.ndarray, k: int, min_score: float) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(qids, np.int64), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = np.full((0, len(ids)), -np.inf)  # this task's best so far, with their rowids
        owner = np.zeros((0, len(ids)), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(a, TEXT_ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rows = part.column(0).to_numpy(zero_copy_only=False)
                score = np.concatenate([best, np.round(flat.reshape(len(rows), -1) @ q.T + 0.0, 4)])
                who = np.concatenate([owner, np.broadcast_to(rows[:, None], (len(rows), len(ids)))])
                order = np.lexsort((who, -score), axis=0)[:k]
                best, owner = np.take_along_axis(score, order, axis=0), np.take_along_axis(who, order, axis=0)
        at = np.nonzero(best >= min_score)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[1]]), pa.array(owner[at]), pa.array(best[at])], names=["qid", "rowid", "score"])

    return vectors.select("rowid", "vec").mapInArrow(run, "qid bigint, rowid bigint, score double")


def coverage(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: docs, embedded (documents that have a vector) and their ratio, 1 without documents."""
    have = docs.select("rowid").join(vectors.select("rowid").distinct(), "rowid", "left_semi").agg(F.count("*").alias("embedded"))
    all_ = docs.agg(F.count("*").alias("docs"))
    ratio = F.when(F.col("docs") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("embedded") / F.col("docs")))
    return all_.join(F.broadcast(have)).select("docs", "embedded", F.round(ratio, 6).alias("coverage"))


def pending(docs: DataFrame, vectors: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest documents without a vector: rowid, text."""
    return docs.join(vectors.select("rowid"), "rowid", "left_anti").select("rowid", "text").orderBy("rowid").limit(limit)


def store(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` vectors with ``new`` ones in place of those of the same document."""
    return upsert(old, new, ["rowid"])


def attach(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(rowid, vec) from stored vectors keyed by session_id, seq and text_hash.

    A vector belongs to a text, not to a row number that may be given to another one.
    """
    mine = docs.select("rowid", "session_id", "seq", text_hash(F.col("text")).alias("text_hash"))
    return mine.join(keyed, ["session_id", "seq", "text_hash"]).select("rowid", "vec")


def keyed_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (rowid, vec) under the keys of ``attach``."""
    return vectors.join(docs, "rowid").select("session_id", "seq", text_hash(F.col("text")).alias("text_hash"), "vec")


def warm_up(docs: DataFrame, vectors: DataFrame, make_embedder, budget: int = SETTINGS.warmup_fast) -> DataFrame:
    """``vectors`` with those of the next ``budget`` documents."""
    return store(vectors, embed_documents(warmup(docs, vectors, budget), make_embedder))


def warmup(docs: DataFrame, vectors: DataFrame, budget: int = SETTINGS.warmup_fast, batch: int = SETTINGS.warmup_batch) -> DataFrame:
    """The next documents to embed, in batches of similar length: rowid, text, batch.

    Within the budget texts are sorted by length, so a batch is padded least.
    """
    todo = pending(docs, vectors, budget)
    order = F.row_number().over(Window.orderBy(F.length("text"), "rowid"))  # over the budget's rows only
    return todo.withColumn("batch", F.floor((order - 1) / batch))


def mean_pool_l2(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of unmasked token vectors, scaled to length 1: ``keys`` and vec.

    ``tokens`` has vec and mask (0 or 1); no unmasked token gives a zero vector.
    """
    one = tokens.select(*keys, "mask", F.posexplode("vec").alias("d", "x"))
    mean = one.groupBy(*keys, "d").agg((F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"])
    pooled = mean.groupBy(*keys).agg(vec.alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    return pooled.select(*keys, F.transform("v", lambda x: F.round(x / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")), 6)).alias("vec"))


@runtime_checkable
class Embedder(Protocol):
    """Turns texts into unit vectors; one instance lives in each Python worker."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Hashed character trigrams, for tests and for use without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            padded = f" {text.lower()} "
            for i in range(len(padded) - 2):
                h = 2166136261
                for c in padded[i : i + 3]:
                    h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
                row[h % self.dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


class OnnxEmbedder:
    """A sentence model: word pieces, mean pooling over unmasked tokens, length 1."""

    def __init__(self, model_path: str, vocabulary_path: str, dim: int = SETTINGS.vector_dim):
        import onnxruntime

        from .wordpiece import WordPiece

        self.dim, self.pieces = dim, WordPiece.load(vocabulary_path)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(model_path, options)

    def embed(self, texts: list[str]) -> np.ndarray:
        ids = [self.pieces.encode(t) for t in texts]
        longest = max(map(len, ids), default=0)
        grid, mask = np.zeros((len(ids), longest), np.int64), np.zeros((len(ids), longest), np.int64)
        for k, x in enumerate(ids):
            grid[k, : len(x)], mask[k, : len(x)] = x, 1
        hidden = self.session.run(["last_hidden_state"], {"input_ids": grid, "attention_mask": mask, "token_type_ids": np.zeros_like(grid)})[0]
        return pool(hidden, mask)


class LazyEmbedder:
    """A model that each process loads when it first embeds, and once.

    ``models`` are places where the model may lie, on every machine; the first that is
    there is taken. A load that fails is not tried again: each later call raises the same error, until
    ``dispose`` forgets what was loaded. Only paths travel to workers.
    """

    _LOADED: ClassVar[dict[tuple, Embedder | Exception]] = {}

    def __init__(self, models: list[str], vocabulary_path: str, dim: int = SETTINGS.vector_dim, load: Callable[[str, str, int], Embedder] = OnnxEmbedder):
        self.models, self.vocabulary_path, self.dim, self.load = tuple(models), vocabulary_path, dim, load

    @property
    def _key(self) -> tuple:
        return (self.models, self.vocabulary_path, self.dim)

    @property
    def available(self) -> bool:
        """Whether there is a model, loaded or not."""
        return first_existing(list(self.models)) is not None

    @property
    def ready(self) -> bool:
        """Whether this process has loaded it."""
        return isinstance(self._LOADED.get(self._key), Embedder)

    def loaded(self) -> Embedder:
        """The model; loads it if this process did not try yet."""
        if self._key not in self._LOADED:
            try:
                path = first_existing(list(self.models))
                if path is None:
                    raise FileNotFoundError(f"no model at {', '.join(self.models)}")
                self._LOADED[self._key] = self.load(path, self.vocabulary_path, self.dim)
            except Exception as error:
                self._LOADED[self._key] = error
        found = self._LOADED[self._key]
        if isinstance(found, Exception):
            raise found
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.loaded().embed(texts)

    def dispose(self) -> None:
        """Forget the model, or that it failed; a second call does nothing."""
        self._LOADED.pop(self._key, None)


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens, then length 1; empty masks and zero vectors stay zero."""
    mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(norm == 0, 1, norm)


def embed_documents(docs: DataFrame, make_embedder, batch: int = SETTINGS.warmup_batch) -> DataFrame:
    """(rowid, vec) of documents' texts; ``make_embedder()`` runs once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame({"rowid": part["rowid"].to_numpy(), "vec": list(embedder.embed(part["text"].fillna("").tolist()).astype(np.float32))})

    return docs.select("rowid", "text").mapInPandas(run, "rowid bigint, vec array<float>")
