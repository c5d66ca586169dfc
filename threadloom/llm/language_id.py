"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features of a letter are the bigram that ends at it and the trigram around it, over
lower-cased characters with everything that is not a letter read as a space; each is
hashed to one of ``BUCKETS``. Counts per language and bucket are summed by Spark;
smoothed log-probabilities, as fixed-point integers so that no sum depends on its
order, form a buckets x languages matrix. The matrix is broadcast: its size is
BUCKETS * languages * 4 bytes, and more than ``MODEL_BYTES`` raises an error.

Fitting reads all labelled documents or, beyond ``SAMPLE`` of a language, a hash
sample of about so many of it. The hash is of doc_id and text, so rows without an id, or
with one repeated id, are drawn each by their own text; copies of one row are drawn
together. A language of which no letter was drawn, since its rows are few different ones,
is drawn again at a higher rate, so none is left out.
Language priors come from the counts of all rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0, so is every
text if nothing was learned; equal scores go to the alphabetically first language;
null doc_ids are kept; repeated rows give repeated results; other columns, of whatever
names, are ignored or, in ``predict``, carried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .staging import small_batches, whole_row
from .textops import slices
from .worker import map_arrow

BUCKETS, SAMPLE, SCALE, MODEL_BYTES = 1 << 15, 20_000, 1 << 16, 64 << 20
CHARS = 1 << 19
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to its lower-cased letter, 0 for all that is not a letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of all texts, and offsets of the texts in them."""
    blob = ("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass")
    c = _fold()[np.frombuffer(blob, np.uint32)]
    begins = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])
    pos = np.flatnonzero(c)
    left, here, right = c[pos - 1], c[pos], c[pos + 1]
    two = left * np.uint32(0x9E3779B1) + here * np.uint32(0x85EBCA77)
    three = two + right * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    out = np.empty(2 * len(pos), np.uint32)
    for k, h in ((0, two), (1, three)):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        out[k::2] = h & np.uint32(BUCKETS - 1)
    return out, 2 * np.searchsorted(pos, begins)


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, fixed-point priors and the buckets x languages matrix."""

    langs: tuple[str, ...]
    priors: np.ndarray
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        texts = [t or "" for t in texts]
        n, k = len(texts), len(self.langs)
        total, letters = np.zeros((n, max(k, 1)), np.int64), np.zeros(n, np.int64)
        for a, b in slices([len(t) for t in texts], max(1, CHARS * 4 // max(4, k))):
            grams, off = gram_buckets(texts[a:b])
            letters[a:b] = np.diff(off)
            if not k or not len(grams):
                continue
            step = max(1, (8 << 20) // k)
            for s in range(0, len(grams), step):  # one very long text is scored piece by piece
                e = min(len(grams), s + step)
                first = np.clip(off, s, e) - s
                rows = np.flatnonzero(np.diff(first))
                values = self.matrix[grams[s:e]]
                total[a + rows] += np.add.reduceat(values, first[rows], axis=0, dtype=np.int64)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        logits = (total + self.priors) / SCALE
        best = (total + self.priors).argmax(axis=1)
        score = 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
        known = letters > 0
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, known)], np.where(known, score, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
        for a, b in slices([len(t) for t in texts], CHARS):
            grams, off = gram_buckets(texts[a:b])
            for k, lang in enumerate(langs[a:b]):
                own = table.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams[off[k] : off[k + 1]], minlength=BUCKETS)
    for lang, own in table.items():
        hit = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(own[hit])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the non-null ``text`` and ``lang`` of ``labelled`` (doc_id, text, lang)."""
    usable = labelled.where("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MODEL_BYTES // (4 * BUCKETS) + 1).collect()}
    if len(per) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(per)} languages make a model of over {MODEL_BYTES} bytes")
    langs = tuple(sorted(per))
    if not langs:
        return Model((), np.zeros(1, np.int64), np.zeros((BUCKETS, 1), np.int32))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_000))
    rates, counts = {lang: min(1.0, sample / n) for lang, n in per.items()}, np.zeros((BUCKETS, len(langs)), np.float64)
    column = {lang: k for k, lang in enumerate(langs)}
    todo = list(langs)
    while todo:
        part = usable if len(todo) == len(langs) else usable.where(F.col("lang").isin(todo))
        for lang in todo:
            if rates[lang] < 1:
                part = part.where((F.col("lang") != lang) | (draw < int(1_000_000 * rates[lang])))
        rows = map_arrow(part.select("lang", "text"), _counts, "lang string, bucket int, n bigint")
        with small_batches(labelled.sparkSession):
            summed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[summed["bucket"].to_numpy(), [column[x] for x in summed["lang"].to_pylist()]] = summed["n"].to_numpy()
        todo = [lang for lang in todo if rates[lang] < 1 and not counts[:, column[lang]].any()]
        rates |= {lang: min(1.0, 16 * rates[lang]) for lang in todo}
    smooth = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))
    prior = np.log(np.array([per[x] for x in langs]) / sum(per.values()))
    return Model(langs, np.rint(prior * SCALE).astype(np.int64), np.rint(smooth * SCALE).astype(np.int32))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] | None = None) -> DataFrame:
    """doc (a struct of the columns of ``carry``, all by default), lang_pred and score of every row.

    The rows travel with their texts, once, so nothing is joined back.
    """
    names = list(docs.columns if carry is None else carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs, names).alias("doc"), *([] if "text" in names else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            texts = doc.field("text") if batch.num_columns == 1 else batch.column(1)
            lang, score = shared.value.predict(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([doc, pa.array(lang, pa.string()), pa.array(score)], names=["doc", "lang_pred", "score"])

    schema = StructType([rows.schema["doc"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_arrow(rows, run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from the rest."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample)
    found = predict(docs, model, ("doc_id",)).select("doc.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
