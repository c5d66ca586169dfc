"""Benchmark decontamination: CGK walks, bit-sampling LSH and exact edit verification.

Symbols are words (see ``textops``), distances are edits of words, and an item is
found in a document when some stretch of it is within ``(1 - SIMILARITY) * words``
edits of the item.

Chakraborty, Goldenberg and Koucky's embedding walks along a window: at step j it
emits the word under it and moves on if the word's j-th random bit is 1, so two
windows that differ by edits fall into step again and emit the same words at most
steps. A repetition is (walk, word offset o in the item where the walk is begun,
sampled steps); its LSH key is the emitted words at the sampled steps. A window that
starts at document word s is walked from word s + o, which is why all repetitions
over o need one key per document word and walk, not one per window. Each length
class of items has its own number of steps, so that no walk depends on what follows
the window; walks are added until planted edits at the allowed distance are found
with chance ``RECALL`` in a simulation over the items of the hardest length. There is
no cap on walks: if ``MOST_WALKS``, many times what any length needs, do not reach the
target, that is an error. ``ItemIndex.measured`` has the walks and the recall found.

Candidates (window, item) pass a counting test that no true match can fail, then a
bit-parallel edit distance decides exactly. Items are sent to all tasks in blocks whose
index takes at most ``INDEX_BYTES``; more items mean more passes, never more memory.

Edge cases: items of null or wordless text match nothing, a null item_id counts and is
listed last, null or wordless documents are clean; items of 1 to 4 words must occur
exactly; repeated items or rows are reported each; null doc_ids are kept; other columns,
of whatever names, are ignored or, in ``clean_documents``, kept as they are; with no
items all is clean.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import numbered, staged, whole_row
from .textops import mix, mix_int, slices, word_hashes
from .worker import map_arrow

SIMILARITY, RECALL, MOST_WALKS = 0.8, 0.99, 64
#: Characters of a block's items, and bytes of the index that is sent for it.
BLOCK_CHARS, INDEX_BYTES = 8 << 20, 192 << 20
_CHARS = 1 << 20
_TABLE = 22


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed for an item of ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def edit_distance_within(item: list[int], text: list[int], most: int) -> int | None:
    """Fewest edits from ``item`` to any stretch of ``text``, None if more than ``most``.

    Myers' bit vectors over Python integers, one step per word of the text.
    """
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for w in text:
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best if best <= most else None


def steps_for(n: int) -> tuple[int, int]:
    """Steps of a walk and how many of them are sampled, for items of ``n`` words."""
    if n >= 15:
        return 14, 6
    if n >= 8:
        return 8, 4
    return (max(1, min(3, n - 1)), max(1, min(2, n - 1)))


def sampled_steps(walk: int, steps: int, taken: int) -> list[int]:
    """The steps a walk's key keeps, always with its first one."""
    draw = random.Random(walk * 1009 + steps * 31 + taken)
    return sorted([0, *draw.sample(range(1, steps), taken - 1)]) if taken > 1 else [0]


def walk_keys(words: np.ndarray, walk: int, steps: int, taken: int) -> np.ndarray:
    """LSH key of the walk from each word on; words past the end emit 0."""
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    bits = mix(padded ^ np.uint64(mix_int(walk + 1)))
    at = np.arange(len(words), dtype=np.int64)
    key = np.full(len(words), mix_int(walk * 64 + steps), np.uint64)
    keep = sampled_steps(walk, steps, taken)
    for j in range(keep[-1] + 1):
        if j in keep:
            key = (key * np.uint64(0x9FB21C651E98DF25)) ^ padded[at]
            key ^= key >> np.uint64(31)
        at += ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key


@dataclass
class _Walk:
    walk: int
    steps: int
    taken: int
    keys: np.ndarray  # sorted
    item: np.ndarray
    offset: np.ndarray
    table: np.ndarray = field(repr=False, default=None)


class ItemIndex:
    """Walk keys of all word offsets of all items, and the exact tests."""

    def __init__(self, texts: list[str | None], similarity: float = SIMILARITY, recall: float = RECALL):
        words, off = word_hashes(texts)
        self.words = [words[a:b] for a, b in zip(off[:-1], off[1:])]
        self.size = np.diff(off)
        self.allowed = np.array([allowed(int(n), similarity) for n in self.size], np.int64)
        self.walks: list[_Walk] = []
        self.measured: dict[int, tuple[int, float]] = {}  # words of an item: walks, recall in the simulation
        classes: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(self.size):
            if n:
                classes.setdefault(steps_for(int(n)), []).append(i)
        for (steps, taken), items in sorted(classes.items()):
            for walk in range(self._most_walks(items, steps, taken, recall)):
                keys = [walk_keys(self.words[i], walk, steps, taken) for i in items]
                n = [len(k) for k in keys]
                flat = np.concatenate(keys)
                order = np.argsort(flat, kind="stable")
                item = np.repeat(items, n)[order]
                offset = np.concatenate([np.arange(x) for x in n])[order]
                self.walks.append(_Walk(walk, steps, taken, flat[order], item, offset))
        member = [mix(self.words[i] ^ np.uint64(mix_int(i))) for i in range(len(self.words)) if len(self.words[i])]
        self._members = np.unique(np.concatenate(member)) if member else np.zeros(0, np.uint64)

    def _most_walks(self, items: list[int], steps: int, taken: int, recall: float) -> int:
        """Walks that the hardest length of a class needs.

        Of lengths with as many edits allowed the shortest is the hardest; a longer item
        with no larger share of edits is no harder than one that the fewest walks find.
        """
        shortest: dict[int, list[int]] = {}
        for i in sorted(items, key=lambda i: self.size[i]):
            same = shortest.setdefault(int(self.allowed[i]), [])
            if not same or self.size[same[0]] == self.size[i]:
                same.append(i)
        most, easy = 2, -1.0
        for k, same in shortest.items():
            share = k / int(self.size[same[0]])
            if share > easy:
                needed = self._walks_needed(same, steps, taken, recall)
                most, easy = max(most, needed), share if needed == 2 else easy
        return most

    @property
    def nbytes(self) -> int:
        """Bytes that are sent to the tasks."""
        walks = sum(w.keys.nbytes + w.item.nbytes + w.offset.nbytes for w in self.walks)
        return walks + self._members.nbytes + sum(w.nbytes + 100 for w in self.words)

    def _walks_needed(self, items: list[int], steps: int, taken: int, recall: float, trials: int = 240) -> int:
        """Fewest walks (two at least) that find the planted edits often enough."""
        draw = random.Random(5)
        pairs = []
        for _ in range(trials):
            i = draw.choice(items)
            item, k = self.words[i], int(self.allowed[i])
            other = item.tolist()
            for _ in range(k):
                p, what = draw.randrange(len(other)), draw.randrange(3)
                if what == 0 or len(other) < 2:
                    other[p] = draw.getrandbits(63)
                elif what == 1:
                    other.insert(p, draw.getrandbits(63))
                else:
                    del other[p]
            text = np.array([draw.getrandbits(63) for _ in range(8)] + other + [draw.getrandbits(63) for _ in range(20)], np.uint64)
            pairs.append((item, text, k))
        for walks in range(1, MOST_WALKS + 1):
            missed = []
            for item, text, k in pairs:
                a, b = walk_keys(item, walks - 1, steps, taken), walk_keys(text, walks - 1, steps, taken)
                x, y = np.nonzero(a[:, None] == b[None, :])
                if not (np.abs(x + 8 - y) <= k).any():
                    missed.append((item, text, k))
            pairs, found = missed, 1 - len(missed) / trials
            self.measured[int(self.size[items[0]])] = walks, found
            if walks > 1 and found >= recall:
                return walks
        raise ValueError(f"{MOST_WALKS} walks find {found:.3f} of the edited items of {int(self.size[items[0]])} words, less than {recall}")

    def tables(self) -> None:
        """Bit tables that reject most keys at once; built in each worker."""
        for w in self.walks:
            if w.table is None:
                w.table = np.zeros(1 << _TABLE, bool)
                w.table[w.keys >> np.uint64(64 - _TABLE)] = True

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start of window, item) pairs that share a key; starts may be negative."""
        self.tables()
        starts, items = [], []
        for w in self.walks:
            key = walk_keys(words, w.walk, w.steps, w.taken)
            at = np.flatnonzero(w.table[key >> np.uint64(64 - _TABLE)])
            low, high = np.searchsorted(w.keys, key[at], "left"), np.searchsorted(w.keys, key[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            starts.append(np.repeat(at, n) - w.offset[row])
            items.append(w.item[row])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(items)]), axis=1)
        return both[0], both[1]

    def plausible(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether enough words of [low, high) are the item's: all but the allowed edits must be."""
        ok = np.zeros(len(item), bool)
        seed = np.array([mix_int(i) for i in range(len(self.words))], np.uint64)
        for a in range(0, len(item), 20_000):
            b = min(len(item), a + 20_000)
            n = high[a:b] - low[a:b]
            which = np.repeat(np.arange(a, b), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
            h = mix(words[at] ^ seed[item[which]])
            place = np.minimum(np.searchsorted(self._members, h), len(self._members) - 1)
            count = np.bincount(which - a, self._members[place] == h, b - a)
            ok[a:b] = count >= (self.size - self.allowed)[item[a:b]]
        return ok

    def found(self, words: np.ndarray, off: np.ndarray) -> dict[int, dict[int, int]]:
        """Text number to {item: edits} for texts with words [off[k], off[k + 1])."""
        start, item = self.candidates(words)
        if not len(item):
            return {}
        k, n = self.allowed[item], self.size[item]
        # windows at a text's edge: the text that holds the window's middle, then the one that holds its ends
        out: dict[int, dict[int, int]] = {}
        for anchor in (np.clip(start + n // 2, 0, len(words) - 1), np.clip(start, 0, len(words) - 1), np.clip(start + n - 1, 0, len(words) - 1)):
            text = np.searchsorted(off, anchor, "right") - 1
            low = np.maximum(start - k, off[text])
            high = np.minimum(start + n + k, off[text + 1])
            good = np.flatnonzero(high - low >= n - k)
            good = good[self.plausible(words, low[good], high[good], item[good])]
            for g in good.tolist():
                t, i = int(text[g]), int(item[g])
                if out.get(t, {}).get(i) == 0:
                    continue
                d = edit_distance_within(self.words[i].tolist(), words[low[g] : high[g]].tolist(), int(k[g]))
                if d is not None:
                    mine = out.setdefault(t, {})
                    mine[i] = min(d, mine.get(i, d))
        return out


def _indexes(items: list[tuple[int | None, str]], similarity: float, recall: float, most: int) -> Iterator[tuple[ItemIndex, list[int | None]]]:
    """Indexes of at most ``most`` bytes (or of one item) that together hold all items."""
    index = ItemIndex([t for _, t in items], similarity, recall)
    if index.nbytes <= most or len(items) < 2:
        yield index, [i for i, _ in items]
    else:
        half = len(items) // 2
        yield from _indexes(items[:half], similarity, recall, most)
        yield from _indexes(items[half:], similarity, recall, most)


def _blocks(benchmark: DataFrame, similarity: float, recall: float, block_chars: int, index_bytes: int) -> Iterator[tuple[ItemIndex, list[int | None]]]:
    """Indexes of all items; the driver holds the texts of one block of about ``block_chars`` at a time."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield from _indexes([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()], similarity, recall, index_bytes)


_LISTED = "item_ids array<bigint>, best_similarity double"


def _scan(rows: DataFrame, index: ItemIndex, ids: list[int | None], clean: bool) -> DataFrame:
    """``rows`` (doc, a struct, and text unless doc has it) with item_ids and best_similarity; with ``clean`` only doc, of rows that hold no item."""
    shared = rows.sparkSession.sparkContext.broadcast((index, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for batch in batches:
            doc = batch.column(0)
            texts = doc.field("text") if batch.num_columns == 1 else batch.column(1)
            lists: list[list[int | None]] = [[] for _ in range(batch.num_rows)]
            best = [0.0] * batch.num_rows
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _CHARS):
                words, off = word_hashes(texts.slice(a, b - a).to_pylist())
                for t, hits in index.found(words, off).items() if len(words) else ():
                    lists[a + t] = sorted((ids[i] for i in hits), key=lambda x: (x is None, x or 0))
                    best[a + t] = max(1 - d / int(index.size[i]) for i, d in hits.items())
            if clean:
                yield pa.RecordBatch.from_arrays([doc.filter(pa.array([not x for x in lists], pa.bool_()))], names=["doc"])
            else:
                yield pa.RecordBatch.from_arrays([doc, pa.array(lists, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=["doc", "item_ids", "best_similarity"])

    listed = StructType.fromDDL(_LISTED).fields
    return map_arrow(rows, run, StructType([rows.schema["doc"], *([] if clean else listed)]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block_chars: int = BLOCK_CHARS, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids, best_similarity.

    ``benchmark`` has item_id and text; its size decides the number of passes. One pass
    needs no row numbers; the results of several are brought together by those of a
    stored copy.
    """
    blocks = _blocks(benchmark, similarity, recall, block_chars, index_bytes)
    first, second = next(blocks), next(blocks, None)
    size = F.size("item_ids")
    out = [(size > 0).alias("contaminated"), size.cast("bigint").alias("n_items"), "item_ids", "best_similarity"]
    if second is None:
        return _scan(docs.select(whole_row(docs, ["doc_id"]).alias("doc"), "text"), *first, False).select("doc.doc_id", *out)
    rows = numbered(docs.select("doc_id", "text"), "leak-rows").select(F.struct("row", "doc.doc_id").alias("doc"), F.col("doc.text").alias("text"))
    found = _scan(rows, *first, False)
    for index, ids in chain([second], blocks):
        found = found.unionByName(_scan(rows, index, ids, False))
    listed = F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids")  # at most one list a block
    found = found.groupBy("doc.row").agg(F.first("doc.doc_id").alias("doc_id"), listed, F.max("best_similarity").alias("best_similarity"))
    return found.select("doc_id", *out)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block_chars: int = BLOCK_CHARS, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Whole rows pass through the scan, so nothing is joined back to them; with several
    blocks of items each scan reads what the one before kept.
    """
    rows = docs.select(whole_row(docs).alias("doc"))
    for k, (index, ids) in enumerate(_blocks(benchmark, similarity, recall, block_chars, index_bytes)):
        rows = _scan(staged(rows, "leak-rest") if k else rows, index, ids, True)
    return rows.select("doc.*")
