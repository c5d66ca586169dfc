"""Token ids in Simple-8b segments, written in ascending doc_id order and read back.

``write_token_files`` range-partitions whole texts by doc_id, encodes each partition
in order and lets Spark write one Parquet part per partition, so files appear by
commit only and a lost task just runs again. A row is one segment: the doc_ids and
id counts of up to ``SEGMENT_DOCS`` documents and one Simple-8b payload of all their
ids (see ``simple8b``). ``read_token_files`` decodes the segments and derives each
document's global start from the partitions' totals, one number per file.

Edge cases: null text is empty (only the end id); null doc_ids come first; repeated
doc_ids, null ones too, follow each other in order of a hash of their text, and are
dealt to as many partitions as they fill; other columns are ignored; an empty table
gives empty files and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .staging import new_path, small_batches
from .textops import slices
from .worker import cached, map_arrow, uncollected

END_ID = 2
SEGMENT_DOCS, SEGMENT_CHARS = 4096, 1 << 21


_MARK, _GAP, _WORDLIKE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[[44, 46]] = _GAP[[10, 32]] = _WORDLIKE[[10, 32]] = True
_WORDLIKE[[c for c in range(256) if chr(c).isalnum()]] = True


def _run_of_marks(text: bytes) -> bool:
    """Whether a Latin-1 text has a full stop or comma before a gap and after another mark."""
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[a[1:-1]])
    return bool((_GAP[a[at + 2]] & ~_WORDLIKE[a[at]]).any())


#: Byte-level vocabularies write a byte that prints as itself, the others as characters from U+0100 on.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: Letters, then marks without white space.
_TAIL = re.compile(r"([^\W\d_]+)((?:[^\w\s\x1c-\x1f]|_)+)")


#: The parts of a tokenizer file under which chunks can be encoded by themselves.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def known_parts(tokenizer: dict) -> bool:
    """Whether a tokenizer file has the parts that ``WordCache`` relies on.

    White space folded to a space and case folded; words split by one pattern and given
    to a plain BPE model as bytes with an ending mark; special strings that begin with ``<|``.
    """
    split, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    parts = split.get("pretokenizers") or [{}, {}]
    return (
        (tokenizer.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(parts) == 2
        and parts[0] == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        and (parts[1].get("type"), parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == ("ByteLevel", False, False)
        and (model.get("type"), model.get("end_of_word_suffix")) == ("BPE", "</w>")
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not tokenizer.get("truncation") and not tokenizer.get("padding")
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in tokenizer.get("added_tokens") or ())
    )


class WordCache:
    """Ids of whole texts through the tokenizers library, one call per new word.

    The tokenizer's pre-tokenizer never joins across a space or line feed, so a text's
    ids are those of its chunks between them, end to end. In Latin-1 texts, whose case
    the tokenizer folds as Python does, chunks are lower-cased first, and full stops and
    commas at a chunk's end are chunks of their own unless they end a run of marks.
    Texts that hold ``<|`` could contain special strings and are encoded whole. Of two
    generations of ``most`` entries each, the older is dropped when the younger is
    full; that costs time only.

    All that holds for one kind of tokenizer; ``known_parts`` checks a file for it, and
    with any other file whole texts go to the library.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as file:
            self.by_words = known_parts(json.load(file))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of chunks, by the cheapest call of the library that gives them.

        Lower-case letters of Latin-1 are their own normal form and one pre-token, so
        they go straight to the library's BPE model, as the characters that stand for
        their bytes. Letters and the marks after them are two pre-tokens, looked up one
        by one. All other chunks are texts to the library.
        """
        made: dict[str, bytes] = {}
        rest, joined, model, young = [], [], self.tokenizer.model.tokenize, self.young
        todo = list(words)
        for w in todo:  # grows by the parts of joined chunks
            if w in made:
                continue
            if w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0100"):
                as_bytes = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS)
                made[w] = array("I", [t.id for t in model(as_bytes)]).tobytes()
            elif (m := _TAIL.fullmatch(w)) and max(w) < "\u0100":
                joined.append((w, m[1], m[2]))
                for part in m.groups():
                    if (got := young.get(part)) is None:
                        todo.append(part)
                    else:
                        made[part] = got
            else:
                rest.append(w)
        rest = list(dict.fromkeys(rest))
        made.update(zip(rest, self._library(rest)))
        for w, base, tail in joined:
            made[w] = made[base] + made[tail]
        return made

    @staticmethod
    def _spaced(text: str) -> str | None:
        """The text with spaces between chunks, or None for a text to encode whole."""
        if "<|" in text:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ")
        text = text.lower().replace("\n", " ")
        if len(raw) > 2 and not _run_of_marks(raw):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        out: list[bytes | None] = list(map(young.get, chunks))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            chunk = chunks[k]
            if (ids := old.get(chunk)) is None:
                new.append(k)
            else:
                out[k] = young[chunk] = ids
        fresh = self._words([chunks[k] for k in new])
        young.update(fresh)
        for k in new:
            out[k] = fresh[chunks[k]]
        return out

    def encode(self, texts: list[str], end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end as uint32, each text's followed by ``end``, and their counts."""
        if not self.by_words:
            lists = [np.concatenate([np.frombuffer(x, "<u4"), np.array(end, "<u4")]) for x in self._library(texts)]
            return np.concatenate([np.zeros(0, "<u4"), *lists]), np.array([len(x) for x in lists], np.int64)
        spaced = [self._spaced(t) for t in texts]
        whole = [k for k, t in enumerate(spaced) if t is None]
        lists = pc.split_pattern(pa.array(["" if t is None else t for t in spaced], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids += self._library([texts[k] for k in whole]) + [np.array(end, "<u4").tobytes()]
        offsets = lists.offsets.to_numpy()
        word = coded.indices.to_numpy(zero_copy_only=False)
        if whole:  # such a text is one empty chunk so far
            word = word.copy()
            word[offsets[whole]] = np.arange(len(ids) - 1 - len(whole), len(ids) - 1)
        word = np.insert(word, offsets[1:], len(ids) - 1)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(word))
        _, ends, data = taken.buffers()
        last = np.frombuffer(ends, np.int64)[offsets[1:] + np.arange(1, len(texts) + 1)] // 4
        out = np.frombuffer(data, "<u4", int(last[-1])) if len(texts) and data is not None else np.zeros(0, "<u4")
        return out, np.diff(last, prepend=0)


_SEGMENT = "part int, segment int, n_docs int, n_ids bigint, doc_ids array<bigint>, counts array<int>, payload binary"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    cache = cached(path, lambda: WordCache(path))
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in slices(lengths, SEGMENT_CHARS):
            for c in range(a, b, SEGMENT_DOCS):
                d = min(b, c + SEGMENT_DOCS)
                with uncollected():
                    ids, counts = cache.encode([t or "" for t in texts.slice(c, d - c).to_pylist()], (end_id,))
                    payload = simple8b.encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([d - c], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids[c:d]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                    names=["part", "segment", "n_docs", "n_ids", "doc_ids", "counts", "payload"],
                )
                number += 1


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write segments below ``path``."""
    # one id may be on any number of rows, and so may one text: they are told apart by row
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "salt"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(docs.sparkSession):
        map_arrow(ordered, lambda it: _segments(it, tokenizer_file, end_id), _SEGMENT).write.option("compression", "zstd").parquet(path)


_DOC = "part int, segment int, place int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["payload"]).astype("<u4")
            counts = np.array(row["counts"], np.int64)
            if len(ids) != row["n_ids"] or counts.sum() != row["n_ids"]:
                raise ValueError(f"segment {row['part']}/{row['segment']} is damaged")
            begins = np.cumsum(counts) - counts
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(begins.tolist(), counts.tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(counts), pa.array(crc, pa.int64())],
                names=["part", "segment", "place", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Starts: segments' id counts are summed over their partition's earlier segments, and
    partitions' totals over earlier partitions. The one unpartitioned window runs over
    one row per partition.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("segment_start")).join(parts, "part")
    docs = map_arrow(segments, _documents, _DOC)
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the files (below the shared folder unless ``path`` is given) and read them back."""
    path = path or new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file, end_id)
    return read_token_files(docs.sparkSession, path)
