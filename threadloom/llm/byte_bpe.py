"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

Encodings of texts are a monoid: ``Codec.join`` makes the ids of a text of those of its two
halves. A text is halved down to leaves of about ``LEAF`` characters, which the tiktoken
library encodes, and halves are joined up the tree. A join encodes a window around the
border anew and keeps the ids outside it, where that is provably the same:

* A *sure border* is a place that no match of the pattern can cross, whatever surrounds
  it: a letter or digit before a mark, a letter before a digit and the reverse, and
  anything else than white space before a space or line feed. Matching never looks
  back, so between two sure borders a text has the same pieces whether it stands alone or
  not. The window grows to the next sure border on either side.
* Where those are far apart, the border lies within one long piece. Merges take the pair
  of lowest rank, the first of equals, so a sequence of tokens is the encoding of its bytes
  if and only if each two neighbours are the encoding of theirs: a first merge across some
  border would be the first for these two as well. So the window grows token by token, and
  may end where its outermost tokens and their outer neighbours encode to themselves.

Decoding puts the bytes of the ids together up a tree as well.

Edge cases: null texts are empty (no ids, no bytes); special strings are ordinary text; null
and repeated doc_ids and repeated rows stay as they are; other columns are not looked at;
an id that the vocabulary does not have is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import cached, map_arrow

#: Characters of a leaf, and from how many on a window within one piece is joined by tokens.
LEAF, LONG = 2048, 512
#: Fixed value: the pattern that the sure borders hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place after such a character and before such a one; only characters whose class no Unicode version doubts.
SURE = re.compile(r"(?<=[!-~À-ÖØ-öø-ʯΑ-ΡΣ-ώА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[ \n])"
                  r"|(?<=[0-9])(?=[!-/:-~À-ÖØ-öø-ʯ])|(?<=[A-Za-zÀ-ÖØ-öø-ʯ一-龥])(?=[!-@\[-`{-~、。，])")  # fmt: skip
#: A piece of one kind: a run of letters, of digits, or of spaces.
ONE_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ʯぁ-ゖァ-ヺ一-龥가-힣]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


class Codec:
    """Encoder and decoder of one ranks file; ``leaf`` and ``long`` are sizes that change no result."""

    def __init__(self, path: str, pattern: str = PATTERN, leaf: int = LEAF, long: int = LONG):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError("joins rest on the borders of another pattern")
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for rank, token in self.bytes.items():
            self.sizes[rank] = len(token)
        # a text longer than any token is never looked up as a whole
        self.leaf, self.long = max(2, leaf), max(long, int(self.sizes.max()) + 1)
        self.fits: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as uint32."""
        return self._span(text, 0, len(text))

    def _span(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return np.array(self.library.encode_ordinary(text[a:b]), "<u4")
        m = (a + b) // 2
        return self.join(text, a, m, b, self._span(text, a, m), self._span(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[a:b] from those of text[a:m] and text[m:b]."""
        p, q = _border_before(text, a, m), _border_after(text, m, b)
        i = self._tokens(left[::-1], len(text[p:m].encode()))
        j = self._tokens(right, len(text[m:q].encode()))
        if q - p >= self.long and ONE_PIECE.fullmatch(text, p, q):
            window = self._join_piece(left[len(left) - i :].tolist(), right[:j].tolist())
        else:
            window = self.library.encode_ordinary(text[p:q])
        return np.concatenate([left[: len(left) - i], np.array(window, "<u4"), right[j:]])

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ``ids`` are ``size`` bytes."""
        ends = np.cumsum(self.sizes[ids[:size]])
        n = int(np.searchsorted(ends, size))
        return n + 1 if size else 0

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one piece from those of its two parts, each a piece by itself."""
        left, right = self._alone(left), self._alone(right)
        i, j = min(1, len(left)), min(1, len(right))
        while True:
            window = self._merged(b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j])))
            before = i == len(left) or (window is not None and self._fit(left[-i - 1], window[0]))
            after = j == len(right) or (window is not None and self._fit(window[-1], right[j]))
            if before and after and window is not None:
                return left[: len(left) - i] + window + right[j:]
            if window is None:  # cut inside a character
                i, j = min(i + 1, len(left)), min(j + 1, len(right))
            else:
                i, j = i if before else min(2 * i, len(left)), j if after else min(2 * j, len(right))

    def _alone(self, ids: list[int]) -> list[int]:
        """A piece that was looked up as a whole, as merges make it."""
        return self._plain(self.bytes[ids[0]]) if len(ids) == 1 else ids

    def _fit(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        if (a, b) not in self.fits:
            if len(self.fits) > 1 << 16:
                self.fits.clear()
            self.fits[a, b] = self._plain(self.bytes[a] + self.bytes[b]) == [a, b]
        return self.fits[a, b]

    def _merged(self, raw: bytes) -> list[int] | None:
        """Tokens of a run of bytes by merges alone; None if it ends inside a character."""
        if len(raw) <= 64 or raw in self.ranks:
            return self._plain(raw)
        try:
            return self.pieces.encode_ordinary(raw.decode())
        except UnicodeDecodeError:
            return None

    def _plain(self, raw: bytes) -> list[int]:
        """Merges one by one: the pair of lowest rank, the first of equals."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            rank, k = min(((self.ranks.get(x + y, 1 << 62), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 62:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[x] for x in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: leaves are looked up, neighbours put together up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def _border_before(text: str, a: int, m: int) -> int:
    """The last sure border in (a, m), else a; looked for in growing windows."""
    size = 32
    while True:
        begin = max(a, m - size)
        last = None
        for last in SURE.finditer(text, begin + 1, m):
            pass
        if last is not None and last.start() < m:
            return last.start()
        if begin == a:
            return a
        size *= 4


def _border_after(text: str, m: int, b: int) -> int:
    """The first sure border in (m, b), else b."""
    found = SURE.search(text, m + 1, b)
    return found.start() if found and found.start() < b else b


def encode_texts(docs: DataFrame, tokenizer_file: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32, as binary) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached((tokenizer_file, leaf), lambda: Codec(tokenizer_file, public_tokenizers.PATTERN, leaf))
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_tokens bigint, ids binary")


def decode_ids(encoded: DataFrame, tokenizer_file: str, leaf: int = LEAF) -> DataFrame:
    """The columns of ``encode_texts`` and decoded, the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached((tokenizer_file, leaf), lambda: Codec(tokenizer_file, public_tokenizers.PATTERN, leaf))
        for batch in batches:
            texts = [codec.decode(np.frombuffer(x.as_buffer() or b"", "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: its ids, and what they decode to."""
    both = decode_ids(encode_texts(docs, tokenizer_file), tokenizer_file)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
