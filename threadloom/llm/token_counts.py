"""Token counts that follow edits, on segment trees over pre-tokens.

A document's state is a segment tree whose leaves are runs of about ``LEAF``
pre-tokens: each leaf keeps its characters and its tokens, inner nodes their sums. The
state is stored as two lists of numbers beside the text; edits are applied to it, not to
a text that is counted anew.

An edit replaces the characters [start, end) of the current text. Pre-tokens are cut
from left to right by a pattern that looks at most ``AHEAD`` characters beyond a
pre-token and never back. So those that end that far before ``start`` stay; cutting
begins at the border of the leaf that holds the next one, and ends at the first of the
old leaves' borders after ``end`` that is a border again, since from there on the same
text is cut in the same way. That takes the leaves touched and seldom one more, in
code, digits or ideographs as in prose; only a pre-token that itself is as long as many
leaves makes a region longer. What was cut is re-encoded and the sums along the paths
to the root are updated; leaves may hold up to twice ``LEAF`` pre-tokens, so the tree
is rebuilt only when their number has to change. No edit copies the text.

The tokenizer is byte-level BPE: a text's tokens are those of its pre-tokens, so each
distinct pre-token is encoded once per worker (the cache is emptied when full).

Edge cases: null text counts as empty (0 tokens); edits are clipped to the text and
applied in order; a null edit list changes nothing, a null edit's text is empty; a
stored state that does not fit its text is an error; repeated rows repeat; null doc_ids
are kept; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import whole_row
from .worker import cached, map_arrow

LEAF, AHEAD = 32, 2
#: Fixed value: the pre-tokenizer's pattern of the byte-level BPE vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)


class TokenCounter:
    """Tokens per pre-token, through the tiktoken library; ``path`` is a ranks file."""

    def __init__(self, path: str, most: int = 200_000):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most, self.encoded = most, 0
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each pre-token; of two generations of counts the older is dropped when full."""
        self.encoded += len(parts)
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for part in set(parts):
            if part not in young:
                young[part] = old.get(part) or len(self.encode(part))
        return np.fromiter(map(young.__getitem__, parts), np.int64, len(parts))


class SumTree:
    """Sums over leaves of (characters, tokens), as an implicit binary tree."""

    def __init__(self, leaves: np.ndarray):
        n = len(leaves)
        self.n, self.width = n, 1 << max(0, (n - 1).bit_length())
        self.node = np.zeros((2 * self.width, 2), np.int64)
        self.node[self.width : self.width + n] = leaves
        level = self.width // 2
        while level:
            self.node[level : 2 * level] = self.node[2 * level : 4 * level : 2] + self.node[2 * level + 1 : 4 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.node[1, 1])

    @property
    def chars(self) -> int:
        return int(self.node[1, 0])

    @property
    def leaves(self) -> np.ndarray:
        return self.node[self.width : self.width + self.n]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) that holds the character; the last one beyond the end."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if char >= before + self.node[k, 0]:
                before += int(self.node[k, 0])
                k += 1
        leaf = k - self.width
        while leaf > 0 and leaf >= self.n:
            leaf -= 1
            before -= int(self.node[self.width + leaf, 0])
        return leaf, before

    def replace(self, first: int, last: int, leaves: np.ndarray) -> "SumTree":
        """Leaves [first, last) become ``leaves``; in place when their number stays."""
        if last - first != len(leaves):
            return SumTree(np.concatenate([self.leaves[:first], leaves, self.leaves[last:]]))
        touched = np.arange(first, last) + self.width
        self.node[touched] = leaves
        while len(touched) and touched[0] > 1:
            touched = np.unique(touched // 2)
            self.node[touched] = self.node[2 * touched] + self.node[2 * touched + 1]
        return self


def leaves_of(text: str, counter: TokenCounter) -> np.ndarray:
    """(characters, tokens) of each run of ``LEAF`` pre-tokens; one empty leaf for no text."""
    parts = _SPLIT.findall(text)
    return _summed(parts, range(0, len(parts), LEAF), counter) if parts else np.zeros((1, 2), np.int64)


def _summed(parts: list[str], starts, counter: TokenCounter) -> np.ndarray:
    both = np.stack([np.fromiter(map(len, parts), np.int64, len(parts)), counter.counts(parts)], axis=1)
    return np.add.reduceat(both, np.fromiter(starts, np.int64), axis=0)


class Document:
    """A text in pieces, one per leaf, with its tree."""

    def __init__(self, text: str, leaves: np.ndarray, counter: TokenCounter):
        self.counter, self.tree = counter, SumTree(leaves)
        if self.tree.chars != len(text):
            raise ValueError(f"a state of {self.tree.chars} characters is not that of a text of {len(text)}")
        ends = np.cumsum(leaves[:, 0]).tolist()
        self.pieces = [text[a:b] for a, b in zip([0, *ends], ends)]

    @classmethod
    def of(cls, text: str, counter: TokenCounter) -> "Document":
        """A document whose state is made from its text."""
        return cls(text, leaves_of(text, counter), counter)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def tokens(self) -> int:
        return self.tree.total

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end); returns how many pre-tokens were re-encoded."""
        size = self.tree.chars
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        first, begin = self.tree.leaf_at(max(0, start - AHEAD))
        last, stop = self.tree.leaf_at(end)
        head = "".join(self.pieces[first : last + 1])
        head = head[: start - begin] + new + head[end - begin :]
        borders, more = {len(head): last + 1}, 0
        while True:
            upto = last + more
            ahead, k = "", upto + 1
            while k < len(self.pieces) and len(ahead) <= AHEAD:  # enough to know where the region's last pre-token ends
                ahead, k = ahead + self.pieces[k], k + 1
            parts, at, found = _SPLIT.findall(head + ahead), 0, None
            for k, part in enumerate(parts):
                at += len(part)
                if at in borders:
                    found = k + 1, borders[at]
                    break
            if found or not head:
                break
            more = 2 * more + 1
            for piece in self.pieces[upto + 1 : last + more + 1]:
                head += piece
                upto += 1
                borders[len(head)] = upto + 1
        many, beyond = found or (0, last + 1)
        self._put(first, beyond, parts[:many])
        return many

    def _put(self, first: int, last: int, parts: list[str]) -> None:
        """Leaves [first, last) are ``parts`` from now on."""
        old = last - first
        if parts:
            keep = old <= len(parts) <= 2 * LEAF * old
            starts = [k * len(parts) // old for k in range(old)] if keep else list(range(0, len(parts), LEAF))
            leaves = _summed(parts, starts, self.counter)
            pieces = ["".join(parts[a:b]) for a, b in zip(starts, [*starts[1:], len(parts)])]
        else:
            whole = old == self.tree.n
            leaves, pieces = np.zeros((int(whole), 2), np.int64), [""] * int(whole)
        self.tree = self.tree.replace(first, last, leaves)
        self.pieces[first:last] = pieces


_STATE = "n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>"


def _lists(leaves: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x[:, k] for x in leaves], pa.list_(pa.int32())) for k in (0, 1)]


def count_tokens(docs: DataFrame, tokenizer_file: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, n_tokens and the tree's leaves (leaf_chars, leaf_tokens) of whole texts."""
    rows = docs.select(whole_row(docs, carry).alias("doc"), *([] if "text" in carry else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached(tokenizer_file, lambda: TokenCounter(tokenizer_file))
        for batch in batches:
            doc = batch.column(0)
            leaves = [leaves_of(t.as_py() or "", counter) for t in (doc.field("text") if batch.num_columns == 1 else batch.column(1))]
            yield pa.RecordBatch.from_arrays([doc, pa.array([int(x[:, 1].sum()) for x in leaves], pa.int64()), *_lists(leaves)], names=["doc", "n_tokens", "leaf_chars", "leaf_tokens"])

    made = map_arrow(rows, run, StructType([rows.schema["doc"], *StructType.fromDDL(_STATE).fields]))
    return made.select("doc.*", "n_tokens", "leaf_chars", "leaf_tokens")


_EDITED = "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_leaves bigint, n_pretokens_encoded bigint, text_after string, leaf_chars array<int>, leaf_tokens array<int>"


def apply_edits(states: DataFrame, tokenizer_file: str) -> DataFrame:
    """Counts, text and state after the edits of each row, from the stored state.

    ``states`` has doc_id, text, leaf_chars and leaf_tokens (see ``count_tokens``) and
    edits: array<struct<start, end, new>>. Returned are doc_id, n_tokens (before),
    n_tokens_after, n_leaves (after), n_pretokens_encoded (by the edits alone),
    text_after, and leaf_chars and leaf_tokens, the state for further edits.
    """
    return _edited(states.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens"), tokenizer_file)


def count_edited(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``apply_edits`` to ``docs`` (doc_id, text, edits) without stored states: each is made where its edits are applied."""
    return _edited(docs.select("doc_id", "text", "edits"), tokenizer_file)


def _edited(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """Edits applied to documents, whose states are the rows' or, where these have none, made from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached(tokenizer_file, lambda: TokenCounter(tokenizer_file))
        for batch in batches:
            out, leaves = [], []
            ids, edits, sides = batch.column(0).to_pylist(), batch.column(2), [batch.column(k) for k in range(3, batch.num_columns)]
            for k, text in enumerate(batch.column(1)):
                if sides:
                    doc = Document(text.as_py() or "", np.stack([x[k].values.to_numpy(zero_copy_only=False) for x in sides], axis=1).astype(np.int64), counter)
                else:
                    doc = Document.of(text.as_py() or "", counter)
                before = doc.tokens
                again = sum(doc.edit(e["start"], e["end"], e["new"] or "") for e in edits[k].as_py() or ())
                out.append((ids[k], before, doc.tokens, doc.tree.n, again, doc.text))
                leaves.append(doc.tree.leaves)
            cols = list(zip(*out)) or [()] * 6
            names = [f.split()[0] for f in _EDITED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(cols)), *_lists(leaves)], names=names)

    return map_arrow(rows, run, _EDITED)


def sample_edits(text: F.Column) -> F.Column:
    """Three edits that every document gets in the query: a word put in at a third, 40
    characters cut at the middle, and a line appended; all by the text's own length."""
    n = F.coalesce(F.length(text), F.lit(0))
    def one(a, b, new):
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(new).alias("new"))

    return F.array(one(F.floor(n / 3), F.floor(n / 3), " inserted"), one(F.floor(n / 2), F.floor(n / 2) + 40, ""), one(n + 9, n + 9, "\nappended line."))
