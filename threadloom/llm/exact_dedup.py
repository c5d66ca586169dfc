"""Exact duplicates through Patricia tries over whole normalised texts.

Copies of a text never meet in one task as full rows:

1. every scan task inserts its texts into a compressed radix trie and writes one row
   per document, carrying the text only for its local owner, the first row of each
   distinct text (a trie that reaches its budget is begun anew, so a scan task can have
   several owners of one text);
2. owners go to partitions by length and content hash, where a trie again decides by
   whole byte strings which texts are equal and keeps the smallest owner at each
   terminal node. Texts with more than ``FAN`` owners are dealt further, by row: each
   of these rounds leaves one owner of ``FAN`` or so, until no text has more of them.
   So a text that every scan task holds is sent to no task more than about ``FAN`` times.

Owners' decisions then reach the members by a join on the owner's row number, whose
values are as many as (task, distinct text) pairs. A trie that outgrows its budget
spills the heaviest child subtree of its root to a local file, to which later texts
of that subtree are appended; spilled subtrees are then built one after another. The
file lives no longer than its task: a task that is run again makes its own.

Edge cases: null text counts as empty; null doc_ids rank below all others; of rows
with equal text and equal doc_id, one is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import can_broadcast, staged
from .worker import map_arrow

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TRIE_BYTES, FAN = 64 << 20, 64


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8").translate(_LOWER)


def _common(a: bytes, i: int, label: bytes) -> int:
    """Length of the common prefix of ``a[i:]`` and ``label``."""
    n = min(len(a) - i, len(label))
    if a[i : i + n] == label[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i + lo : i + mid] == label[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes, end: list | None = None):
        self.label, self.kids, self.end = label, {}, end


class _Spool:
    """A spilled subtree: (rest of key, item) records, and how many first bytes all rests share."""

    def __init__(self):
        self.file, self.first, self.shared = tempfile.TemporaryFile(), None, 0

    def add(self, key: bytes, item: object) -> None:
        if self.first is None:
            self.first, self.shared = key, len(key)
        self.shared = _common(key, 0, self.first[: self.shared])
        pickle.dump((key, item), self.file)

    def drain(self) -> Iterator[tuple[bytes, object]]:
        self.file.seek(0)
        with self.file:
            while True:
                try:
                    yield pickle.load(self.file)
                except EOFError:
                    return


class PatriciaTrie:
    """Byte strings with a payload list at each terminal, spilling by subtree."""

    def __init__(self, budget: int = TRIE_BYTES, skip: int = 0):
        self.root, self.budget, self.skip = _Node(b""), budget, skip
        self.weight: dict[int, int] = {}
        self.total = self.spills = 0
        self.spilled: dict[int, _Spool] = {}

    def insert(self, key: bytes, item: object) -> list:
        """Append ``item`` at the node of ``key``; the node's items so far are returned."""
        i = self.skip
        first = key[i] if i < len(key) else -1
        if first in self.spilled:
            self.spilled[first].add(key[i:], item)
            return [item]
        node = self.root
        if first < 0:
            node.end = node.end or []
            node.end.append(item)
            return node.end
        grown = 0
        while True:
            kid = node.kids.get(key[i])
            if kid is None:
                kid = node.kids[key[i]] = _Node(key[i:])
                grown += len(key) - i + 200
            n = _common(key, i, kid.label)
            if n < len(kid.label):
                middle = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                middle.kids[kid.label[0]] = kid
                node.kids[key[i]] = kid = middle
                grown += 200
            i += n
            if i == len(key):
                kid.end = kid.end or []
                kid.end.append(item)
                if grown:  # may spill the subtree just filled, so it comes last
                    self._grow(first, grown)
                return kid.end
            node = kid

    def _grow(self, first: int, size: int) -> None:
        self.weight[first] = self.weight.get(first, 0) + size
        self.total += size
        if self.total > self.budget:
            heavy = max(self.weight, key=self.weight.__getitem__)
            kid = self.root.kids[heavy]
            if not kid.kids:
                return  # one string only: it cannot be divided
            spool = self.spilled[heavy] = _Spool()
            for key, items in self._walk(kid, b""):
                for item in items:
                    spool.add(key, item)
            del self.root.kids[heavy]
            self.total -= self.weight.pop(heavy)
            self.spills += 1

    @staticmethod
    def _walk(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.end:
                yield key, node.end
            stack.extend((k, key) for k in node.kids.values())

    def terminals(self) -> Iterator[list]:
        """The items of every terminal; spilled subtrees come last, one at a time."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.end:
                yield node.end
            stack.extend(node.kids.values())
        self.root = _Node(b"")
        while self.spilled:
            _, spool = self.spilled.popitem()
            sub = PatriciaTrie(self.budget, spool.shared)
            for key, item in spool.drain():
                sub.insert(key, item)
            yield from sub.terminals()


_LOCAL = "row bigint, doc_id bigint, owner bigint, digest string, part bigint, body binary"
_OWNERS = "owner bigint, low bigint"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kind = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


def _local(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Round 1: one row per document; only a text's first row in the trie has its body.

    A trie that reaches the budget is dropped and a new one begun: copies that come
    later are owners once more, which round 2 resolves.
    """
    trie, used = PatriciaTrie(1 << 62), 0
    for batch in batches:
        out = []
        for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            body = normalise(text.as_py())
            if used > budget:
                trie, used = PatriciaTrie(1 << 62), 0
            items = trie.insert(body, row)
            fresh = len(items) == 1
            del items[1:]
            used += len(body) + 400 if fresh else 0
            part = xxhash.xxh64_intdigest(body, seed=len(body)) >> 1
            out.append((row, doc_id, items[0], hashlib.sha256(body).hexdigest(), part, body if fresh else None))
        yield _batch(out, _LOCAL)


def _owners(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Round 2: every owner with the smallest owner of the same text."""
    trie = PatriciaTrie(budget)
    for batch in batches:
        for row, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            trie.insert(body.as_py(), row)
    out: list[tuple] = []
    for items in trie.terminals():
        low = min(items)
        out.extend((row, low) for row in items)
        if len(out) >= 5000:
            yield _batch(out, _OWNERS)
            out = []
    yield _batch(out, _OWNERS)


def _grouped(bodies: DataFrame, budget: int, *keys: Column | str) -> DataFrame:
    """owner and low of ``bodies`` (owner, body), dealt by ``keys``."""
    return map_arrow(bodies.repartition(*keys).select("owner", "body"), lambda it: _owners(it, budget), _OWNERS)


def _thinned(bodies: DataFrame, budget: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(bodies, met): owners with their texts, at most about ``fan`` of a text, and (owner, low) of those that gave way.

    Owners of texts that have too many of them are set apart once; no other body is written
    again. Each round deals them to as many tries as keep ``fan`` apiece; the smallest of
    each trie goes on.
    """
    def crowded(owners: DataFrame) -> DataFrame:
        counted = owners.groupBy("part").agg(F.count("*").alias("n"))
        return staged(counted.where(F.col("n") > fan).select("part", F.ceil(F.col("n") / fan).alias("tries")), "dedup-hot")

    def near(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if can_broadcast(small) else small

    hot = crowded(bodies)
    if hot.isEmpty():
        return bodies, None
    calm = bodies.join(near(hot.select("part")), "part", "left_anti")
    many, met = staged(bodies.join(near(hot.select("part")), "part", "left_semi"), "dedup-bodies"), []
    while not hot.isEmpty():
        dealt = many.join(near(hot), "part")
        low = staged(_grouped(dealt, budget, F.col("part"), F.pmod(F.xxhash64("owner"), F.col("tries"))), "dedup-low")
        met.append(low.where("owner <> low"))
        gone = met[-1].select("owner")
        if gone.isEmpty():  # different texts of one hash
            break
        many = staged(many.join(near(gone), "owner", "left_anti"), "dedup-bodies")
        hot = crowded(many)
    chain = None  # the last round's owners first: each earlier one is led on to where they went
    for links in reversed(met):
        if chain is not None:
            on = chain.select(F.col("owner").alias("low"), F.col("low").alias("end"))
            chain = chain.unionByName(links.join(on, "low", "left").select("owner", F.coalesce("end", "low").alias("low")))
        else:
            chain = links
    return calm.unionByName(many.select(*calm.columns)), chain


def exact_duplicates(docs: DataFrame, budget: int = TRIE_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    local = staged(map_arrow(rows, lambda it: _local(it, budget), _LOCAL), "dedup-local")
    bodies, met = _thinned(local.where("body is not null").select("owner", "part", "body"), budget, fan)
    groups = _grouped(bodies, budget, "part")
    if met is not None:
        groups = staged(groups, "dedup-groups")
        ends = groups.select(F.col("owner").alias("low"), F.col("low").alias("end"))
        groups = groups.unionByName(met.join(ends, "low").select("owner", F.col("end").alias("low")))
    # a group's winner: largest doc_id, then first row; its rows here are local winners only
    best = local.groupBy("owner").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("minus_row"))).alias("top"), F.count("*").alias("n"))
    owned = staged(groups.join(best, "owner"), "dedup-owned")
    winners = owned.groupBy("low").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"))
    decided = owned.select("owner", "low").join(winners, "low").drop("low")
    return local.select("row", "doc_id", "owner", "digest").join(decided, "owner").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("top.minus_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
