"""Jaccard self-join of documents' five-word shingle sets by chosen paths.

A path of a set x is a sequence of its tokens: a token extends a path in repetition r
if its hash under (r, path) is below 1 / (LAMBDA * |x|), so 1 / LAMBDA of x's tokens
do on average, and similar sets choose the same ones. Sets with the same path of
``DEPTH`` tokens share a bucket, in which those whose byte sketches agree are linked,
breadth first, so that no pairs are listed. In a bucket of more than ``LEAF`` sets all
are compared to one pivot first, row by row in any number of tasks: if all agree (near
copies) that is all; if few do not, they meet the others in tasks of ``LEAF`` sets;
else the bucket is split by longer paths, up to ``MAX_DEPTH``, beyond which it is
compared block by block. Repetitions go on to ``repetitions(recall)``.

Components of those candidate links get their texts, once each, and every pair of
distinct sets in a component is verified exactly (as a blocked 0/1 matrix product, in
block pairs when a component is large). Links are counted there, so each pair counts
once, whatever number of buckets it met in.

Documents with the same shingle set are one class from the start: they share a
128-bit fingerprint, and only the class goes on. The result has one row per document:

    doc_id, class_id    smallest doc_id of the documents it is linked to, directly or on
    n_links             other documents with a similarity of at least ``threshold``
    n_set_links         other distinct shingle sets with such a similarity
    set_id, n_shingles  the shingle set's class (its smallest doc_id) and its size

Edge cases: texts of 1 to 4 words have one shingle of all their words; texts without
words (null, empty) are linked to nothing and are their own class; null doc_ids are
kept, as a class id only if all of the class are null; repeated rows count as copies;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import can_broadcast, numbered, staged
from .textops import mix, mix_int, shingle_sets, slices
from .worker import map_arrow

THRESHOLD, WIDTH, LAMBDA, RECALL = 0.8, 5, 0.75, 0.995
DEPTH, MAX_DEPTH, LEAF, BLOCK, BLOCK_TOKENS = 2, 4, 512, 1024, 1 << 21
SKETCH, SKETCH_SLACK = 256, 0.17
_CHARS = 1 << 20


def survival(threshold: float, lam: float, depth: int) -> float:
    """Chance that two sets of equal size share a path: a branching process of shared choices."""
    mean, alive = threshold / lam, 1.0  # |x & y| / max(|x|, |y|) is at least the similarity
    for _ in range(depth):
        alive = 1 - math.exp(-mean * alive)
    return alive


def repetitions(recall: float = RECALL, threshold: float = THRESHOLD, lam: float = LAMBDA, depth: int = MAX_DEPTH) -> int:
    """Repetitions after which a pair at the threshold has met with chance ``recall``, even in the deepest bucket."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, lam, depth)))


def _extend(sets: np.ndarray, off: np.ndarray, owner: np.ndarray, seed: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """All one-token extensions of paths: (index of the path, new path hash)."""
    size = off[owner + 1] - off[owner]
    limit = np.minimum(2.0**64 / (lam * np.maximum(size, 1)), 2.0**64 - 4096).astype(np.uint64)
    out_path, out_hash = [], []
    bounds = np.concatenate([[0], np.cumsum(size)])
    step = 1 << 18
    a = 0
    while a < len(owner):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
        n = size[a:b]
        path = np.repeat(np.arange(a, b), n)
        token = sets[np.arange(int(n.sum())) - np.repeat(bounds[a:b] - bounds[a], n) + np.repeat(off[owner[a:b]], n)]
        h = (token ^ seed[path]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hit = np.flatnonzero(h < limit[path])
        out_path.append(path[hit])
        out_hash.append(mix(seed[path[hit]] * np.uint64(31) + mix(token[hit])))
        a = b
    if not out_path:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_path), np.concatenate(out_hash)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One byte per range of token values: of the range's smallest token; 0 if it has none."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    for row, s in zip(out, sets):
        slot = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(s) else np.zeros(0, int)
        row[slot[first]] = (s[first] & np.uint64(0xFF)).astype(np.uint8) | 1
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_SETS = "row bigint, doc_id bigint, fp1 bigint, fp2 bigint, n int, paths array<bigint>, sketch binary"


def _describe(batches: Iterator[pa.RecordBatch], reps: int, lam: float, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """Fingerprint, paths of ``depth`` tokens and sketch of every document."""
    for batch in batches:
        texts = batch.column(2)
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _CHARS):
            sets = shingle_sets(texts.slice(a, b - a).to_pylist(), width)
            n = np.array([len(s) for s in sets], np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            flat = np.concatenate(sets)
            mixed = mix(flat)
            run1, run2 = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mixed, mix(mixed + np.uint64(1))))
            fp1 = mix(run1[off[1:]] - run1[off[:-1]] + n.astype(np.uint64))
            fp2 = mix(run2[off[1:]] - run2[off[:-1]])
            docs, paths = [], []
            for r in range(reps):
                owner = np.flatnonzero(n)
                seed = np.full(len(owner), mix_int(r + 1), np.uint64)
                for _ in range(depth):
                    at, seed = _extend(flat, off, owner, seed, lam)
                    owner = owner[at]
                docs.append(owner)
                paths.append(seed)
            docs, paths = np.concatenate(docs), np.concatenate(paths)
            order = np.argsort(docs, kind="stable")
            ends = np.searchsorted(docs[order], np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _signed(fp1), _signed(fp2), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), _signed(paths[order])), pa.array([x.tobytes() for x in _sketches(sets)], pa.binary())],
                names=["row", "doc_id", "fp1", "fp2", "n", "paths", "sketch"],
            )


_PATHS = "sid bigint, path bigint"


def _longer(batches: Iterator[pa.RecordBatch], lam: float, width: int) -> Iterator[pa.RecordBatch]:
    """One token more for the given paths of each set."""
    for batch in batches:
        texts = batch.column(2)
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), _CHARS):
            sets = shingle_sets(texts.slice(a, b - a).to_pylist(), width)
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            lists = batch.column(1).slice(a, b - a)
            owner = np.repeat(np.arange(b - a), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            seed = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, new = _extend(np.concatenate(sets), off, owner, seed, lam)
            sid = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(sid[owner[at]]), _signed(new)], names=["sid", "path"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _agree(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches and sizes allow a similarity of ``threshold``."""
    size = (np.minimum(n_one, n_many) >= threshold * np.maximum(n_one, n_many)).nonzero()[0]
    ok = np.zeros(len(many), bool)
    if len(size):
        near = many[size]
        same = ((near == one) & (one != 0)).sum(axis=1)
        either = ((near != 0) | (one != 0)).sum(axis=1)
        ok[size] = same >= (threshold - SKETCH_SLACK) * either
    return ok


_AGREED = "path bigint, sid bigint, pivot bigint, ok boolean"


def _to_pivot(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Whether each set (path, sid, n, sketch) agrees with its bucket's pivot (sid, n, sketch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, n_pivot = (batch.column(k).to_numpy() for k in (2, 5))
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (3, 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(_agreeing(one, n, two, n_pivot, threshold))], names=["path", "sid", "pivot", "ok"])


def _agreeing(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray, threshold: float) -> np.ndarray:
    """``_agree`` for rows of two tables."""
    same = ((one == two) & (one != 0)).sum(axis=1)
    either = ((one != 0) | (two != 0)).sum(axis=1)
    return (np.minimum(n_one, n_two) >= threshold * np.maximum(n_one, n_two)) & (same >= (threshold - SKETCH_SLACK) * either)


_LINKS = "a bigint, b bigint"


def _bucket_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links that join all agreeing sets of a bucket (or of a pair of its blocks).

    Breadth first: a set is compared to those not reached yet, so a bucket of near
    copies takes one comparison each, and no more links than sets come out.
    """
    a, b = [], []
    for t in _groups(batches, ["path", "i", "j"]):
        sid, n = t["sid"].to_numpy(), t["n"].to_numpy()
        sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(sid), SKETCH)
        left = np.arange(len(sid))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                p = queue.pop()
                ok = _agree(sk[p], n[p], sk[left], n[left], threshold)
                got, left = left[ok], left[~ok]
                a.extend([sid[p]] * len(got))
                b.extend(sid[got])
                queue.extend(got)
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def intersections(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Exact |x & y| for all pairs (of the first ``split`` with the rest, if given)."""
    m = len(sets)
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = int((df == m).sum())
    wanted = np.flatnonzero((df > 1) & (df < m))
    place = np.full(len(tokens), -1)
    place[wanted] = np.arange(len(wanted))
    column = place[column]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    cut = m if split is None else split
    out = np.zeros((cut, m if split is None else m - split), np.float32)
    step = 4096
    for c in range(0, len(wanted), step):
        x, y = np.searchsorted(column, [c, c + step])
        dense = np.zeros((m, min(step, len(wanted) - c)), np.float32)
        dense[rows[x:y], column[x:y] - c] = 1
        out += dense[:cut] @ (dense.T if split is None else dense[cut:].T)
    return out + everywhere


_VERIFIED = "sid bigint, peer bigint, copies bigint, sets bigint"


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """Per set of a component (or block pair): its number of links and one linked peer.

    Peers are those of a spanning forest of the verified links, as (sid, peer) rows.
    """
    for t in _groups(batches, ["comp", "i", "j"]):
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        side = t["block"].to_numpy()
        order = np.argsort(side != i, kind="stable")
        sid, weight = t["sid"].to_numpy()[order], t["copies"].to_numpy()[order]
        texts = t["text"].take(pa.array(order)).to_pylist()
        sets = [s for a, b in slices([len(x) for x in texts], _CHARS) for s in shingle_sets(texts[a:b], width)]
        size = np.array([len(s) for s in sets], np.int64)
        cut = None if i == j else int((side == i).sum())
        if i != j and cut in (0, len(sid)):
            continue
        common = intersections(sets, cut)
        rows_n, cols_n = (size, size) if cut is None else (size[:cut], size[cut:])
        linked = common >= threshold * (rows_n[:, None] + cols_n[None, :] - common) - 1e-6
        if cut is None:
            np.fill_diagonal(linked, False)
            copies, count = linked @ weight, linked.sum(axis=1)
        else:
            copies = np.concatenate([linked @ weight[cut:], linked.T @ weight[:cut]])
            count = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
        peer = _forest(linked, len(sid), cut)
        some = np.flatnonzero((count > 0) | (peer >= 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid[some]), pa.array([sid[p] if p >= 0 else None for p in peer[some]], pa.int64()), pa.array(copies[some].astype(np.int64)), pa.array(count[some].astype(np.int64))],
            names=["sid", "peer", "copies", "sets"],
        )


def _forest(linked: np.ndarray, m: int, cut: int | None) -> np.ndarray:
    """Parent of each node in a spanning forest of the links, -1 for roots."""
    parent, fresh = np.full(m, -1), np.ones(m, bool)
    for s in range(m):
        if not fresh[s]:
            continue
        fresh[s], queue = False, [s]
        while queue:
            p = queue.pop()
            if cut is None:
                got = np.flatnonzero(linked[p] & fresh)
            elif p < cut:
                got = cut + np.flatnonzero(linked[p] & fresh[cut:])
            else:
                got = np.flatnonzero(linked[:, p - cut] & fresh[:cut])
            fresh[got], parent[got] = False, p
            queue.extend(got.tolist())
    return parent


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows with ``blocks`` dealt to pairs of blocks: columns block, i, j.

    One block gives the pair (0, 0); of k blocks each row goes to k pairs.
    """
    own = F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int")
    many = rows.withColumn("block", own).withColumn("other", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")))
    return many.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (a staged table with sid) with their texts.

    Rows of a few bytes in all are sent to the scan, so no other text moves; beyond
    that both sides are shuffled.
    """
    return texts.join(F.broadcast(rows) if can_broadcast(rows) else rows, "sid")


def _pivoted(big: DataFrame, sketches: DataFrame, threshold: float, leaf: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, dealt, rest) of buckets (sid, path, m) with more than ``leaf`` sets.

    ``links`` join each bucket's sets to its pivot where they agree. Where at most
    ``leaf`` sets do not, ``dealt`` (sid, path, i, j) gives them to each task of others;
    with more of them the whole bucket is in ``rest``.
    """
    rows = big.select("sid", "path").join(sketches, "sid")
    pivots = rows.groupBy("path").agg(F.min_by(F.struct("sid", "n", "sketch"), F.xxhash64("sid", "path")).alias("p"))
    both = rows.join(pivots, "path").select("path", "sid", "n", "sketch", F.col("p.sid").alias("p_sid"), F.col("p.n").alias("p_n"), F.col("p.sketch").alias("p_sketch"))
    met = staged(map_arrow(both, lambda it: _to_pivot(it, threshold), _AGREED), "join-pivots")
    links = met.where("ok and sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    apart = staged(met.groupBy("path").agg(F.count_if(~F.col("ok")).alias("u"), F.count_if("ok").alias("r")).where("u > 0"), "join-apart")
    few = met.join(apart.where(F.col("u") <= leaf), "path").withColumn("blocks", F.ceil(F.col("r") / leaf).cast("int"))
    block = F.when(F.col("ok"), F.array(F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int"))).otherwise(F.expr("sequence(0, blocks - 1)"))
    dealt = few.select("sid", "path", F.explode(block).alias("i"), F.lit(-1).alias("j"))
    return links, dealt, big.join(apart.where(F.col("u") > leaf).select("path"), "path", "left_semi")


def similar_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_set_links, set_id, n_shingles.

    Rows are numbered in a stored copy of the texts, which the later scans read. For
    ``settings`` see ``similar_rows``.
    """
    rows = numbered(docs.select("doc_id", "text"), "join-rows")
    return similar_rows(rows, **settings).drop("row", "class_row")


def similar_rows(
    rows: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, lam: float = LAMBDA, leaf: int = LEAF, block: int = BLOCK
) -> DataFrame:
    """The same for rows as ``staging.numbered`` makes them, with row and class_row, the smallest row of the class."""
    reps = repetitions(recall, threshold, lam)
    base = rows.select("row", "doc.doc_id", "doc.text")
    made = staged(map_arrow(base, lambda it: _describe(it, reps, lam, DEPTH, width), _SETS), "join-sets")
    texts = base.select(F.col("row").alias("sid"), "text")
    # a class per distinct set, numbered by its first row
    per_set = made.groupBy("fp1", "fp2").agg(F.min("row").alias("sid"), F.min("doc_id").alias("set_id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = staged(per_set, "join-classes")
    firsts = made.where("n > 0").join(classes.select("sid"), F.col("row") == F.col("sid"))
    sketches = made.select(F.col("row").alias("sid"), "n", "sketch")
    one = F.lit(0).alias("i"), F.lit(0).alias("j")
    current, dealt, links = firsts.select("sid", F.explode("paths").alias("path")), [], []
    for depth in range(DEPTH, MAX_DEPTH + 1):
        shared = current.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
        current = staged(current.join(shared, "path"), f"join-paths-{depth}")
        dealt.append(current.where(F.col("m") <= leaf).select("sid", "path", *one))
        big = current.where(F.col("m") > leaf)
        if big.isEmpty():
            break
        near, apart, big = _pivoted(big, sketches, threshold, leaf)
        links.append(near)
        dealt.append(apart)
        if big.isEmpty():
            break
        if depth == MAX_DEPTH:
            dealt.append(_blocked(big.select("sid", "path", F.ceil(F.col("m") / leaf).alias("blocks"))).select("sid", "path", "i", "j"))
            break
        tall = staged(big.groupBy("sid").agg(F.collect_list("path").alias("paths")), "join-split")
        current = map_arrow(_with_text(tall, texts).select("sid", "paths", "text"), lambda it: _longer(it, lam, width), _PATHS)
    buckets = reduce(DataFrame.unionByName, dealt)
    sketched = buckets.join(sketches, "sid").select("path", "i", "j", "sid", "n", "sketch")
    sketched = sketched.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    links = reduce(DataFrame.unionByName, [map_arrow(sketched, lambda it: _bucket_links(it, threshold), _LINKS), *links])
    comps = connected_components(links).select(F.col("node").alias("sid"), F.col("root").alias("comp")).join(classes.select("sid", "copies", "n"), "sid")
    comps = staged(comps, "join-candidates")
    most = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_TOKENS))
    members = staged(_blocked(comps.join(comps.groupBy("comp").agg(most.alias("blocks")), "comp")).select("comp", "i", "j", "block", "sid", "copies"), "join-members")
    members = _with_text(members, texts).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    members = members.select("comp", "i", "j", "block", "sid", "copies", "text")
    verified = staged(map_arrow(members, lambda it: _verify(it, threshold, width), _VERIFIED), "join-verified")
    roots = connected_components(verified.where("peer is not null").select(F.col("sid").alias("a"), F.col("peer").alias("b")))
    counts = verified.groupBy("sid").agg(F.sum("copies").alias("linked"), F.sum("sets").alias("n_set_links"))
    in_root = roots.withColumnRenamed("node", "sid").join(classes.select("sid", "set_id"), "sid")
    named = in_root.select("sid", "root").join(in_root.groupBy("root").agg(F.min("set_id").alias("class_id"), F.min("sid").alias("class_row")), "root").select("sid", "class_id", "class_row")
    known = classes.join(named.join(counts, "sid"), "sid", "left").select(
        "fp1", "fp2", "set_id", "copies", F.coalesce("class_row", "sid").alias("class_row"), F.coalesce("class_id", "set_id").alias("class_id"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links")
    )
    empty = F.col("n") == 0
    return made.select("row", "doc_id", "fp1", "fp2", "n").join(known, ["fp1", "fp2"]).select(
        "doc_id", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("linked") + F.col("copies") - 1).alias("n_links"), "n_set_links",
        F.when(empty, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"), F.col("n").alias("n_shingles"),
        "row", F.when(empty, F.col("row")).otherwise(F.col("class_row")).alias("class_row"),
    )
