"""Mixing sources to target weights by pivotal dependent rounding, DataFrame only.

Every document of a source is wanted r = target / source size times, so it is taken
floor(r) times for sure and has a fractional probability p for one copy more. Two
documents with fractional p duel: probability mass, measured in words, moves from
one to the other until one p is 0 or 1; the direction is drawn so that neither
expectation changes. As p1 * size1 + p2 * size2 stays what it was, a source's taken
words end within one document's size of its target.

Duels run in a reduction tree. Level 0 deals a source's documents by hash into
chunks of about ``CHUNK``; each chunk is folded in one ``aggregate`` expression to
settled documents and at most one residual; the residuals of ``CHUNK`` neighbours
are the next level's chunk, up to one residual per source, which is drawn alone.
A hot source has more chunks, never larger ones. All draws are hashes of a document's
key (its id and text) and the seed, so reruns agree however the table is split; only
rows that are the same in both, of which it does not matter which one is taken, are
told apart by their row numbers, and dealt by them where there are over ``CHUNK``.

Sources are ranked and their level is found without gathering them: they are ordered
by range, counted and summed per range, and ranges after one another.

Edge cases: null text has size 0; documents of size 0 and documents of a source
whose target is 0 take no words; a null source is a source of its own, last in
order; null and repeated doc_ids are documents like others; an empty table gives an
empty result; other columns, of whatever names, are ignored by ``mix`` and kept as
they are by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import can_broadcast, numbered, staged

WEIGHTS, SHARE, CAP, CHUNK, SEED = (5, 2, 1), 1.5, 2, 64, 42
_EPS = "1e-9D"


def text_size(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _ranged(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` stored in ranges of ``order``, with the range's number as ``part``."""
    return staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _before(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per range of ``df`` the sums of ``totals`` over the ranges before it; the window runs over one row per range."""
    per = df.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    return per.select("part", *[F.coalesce(F.sum(n).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n) for n in totals])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source_size, n_docs, weight, target.

    Targets are level * weight, stopped at cap * source_size, with the one level at
    which they sum to ``share`` of all sizes; that is where repeated resharing ends.
    A source is free (not stopped) if the level that is left for it and those after it,
    in order of cap * size / weight, is below its own; the first free one has the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = F.col("source").asc_nulls_last()
    per = _ranged(per, "mix-sources", named)
    place = F.row_number().over(Window.partitionBy("part").orderBy(named)) - 1 + F.col("first")
    per = per.join(F.broadcast(_before(per, {"first": F.lit(1)})), "part").withColumn("place", place)  # a row per range
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", "n_docs", weight.alias("weight"), (cap * F.col("source_size").cast("double")).alias("top"))
    per = per.withColumn("own", F.col("top") / F.col("weight"))
    per = _ranged(per, "mix-levels", F.col("own"), named)
    sums = per.agg((share * F.sum("source_size").cast("double")).alias("budget"), F.sum("weight").alias("weights"))
    earlier = Window.partitionBy("part").orderBy("own", named).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, base: F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) + F.col(base)
    ranked = per.join(F.broadcast(_before(per, {"tops": F.col("top"), "used": F.col("weight")})), "part").withColumn("top_before", so_far("top", "tops")).withColumn("weight_before", so_far("weight", "used"))
    level = (F.col("budget") - F.col("top_before")) / (F.col("weights") - F.col("weight_before"))
    found = ranked.join(F.broadcast(sums)).withColumn("level", level).where(F.col("level") * F.col("weight") < F.col("top"))  # sums is one row
    final = found.agg(F.min(F.struct("own", F.col("source").isNull().alias("last"), "source", "level"))["level"].alias("final"))
    return per.join(F.broadcast(final)).select(  # final is one row
        "source", "source_size", "n_docs", "weight",
        F.when(F.col("final").isNull(), F.col("top")).otherwise(F.least("top", F.col("final") * F.col("weight"))).alias("target"),
    )


_ITEM = "struct<id: bigint, row: bigint, size: bigint, p: double>"


def _uniform(*parts: str, level: int, seed: int) -> str:
    """A uniform number in [0, 1) from ids, as SQL."""
    return f"(pmod(xxhash64({', '.join(parts)}, {level}, {seed}), 1073741824) / 1073741824D)"


def _fold(level: int, seed: int) -> Column:
    """Fold the sorted array ``items`` to struct(out: settled items, held: the residual).

    With h held and x next, h can gain up = min(words it lacks, words x has) and lose
    down = min(words it has, words x lacks). It gains ``up`` with probability
    down / (up + down), else it loses ``down``: one of the two is then settled.
    """
    u = _uniform("h.id", "x.id", level=level, seed=seed)
    up, down = "least(h.size * (1 - h.p), x.size * x.p)", "least(h.size * h.p, x.size * (1 - x.p))"
    moved = f"CASE WHEN {u} * ({up} + {down}) < {down} THEN {up} ELSE -{down} END"
    item = "named_struct('id', {0}.id, 'row', {0}.row, 'size', {0}.size, 'p', {1})".format
    return F.expr(f"""
      aggregate(items, named_struct('out', cast(array() as array<{_ITEM}>), 'held', cast(null as {_ITEM})), (s, x) ->
        CASE WHEN s.held IS NULL THEN named_struct('out', s.out, 'held', x)
        ELSE element_at(transform(array(s.held), h ->
          element_at(transform(array({moved}), d ->
            element_at(transform(array(named_struct('h', h.p + d / h.size, 'x', x.p - d / x.size)), q ->
              CASE WHEN q.h < {_EPS} OR q.h > 1 - {_EPS}
              THEN named_struct('out', concat(s.out, array({item("h", "round(q.h)")})), 'held', {item("x", "q.x")})
              ELSE named_struct('out', concat(s.out, array({item("x", "round(q.x)")})), 'held', {item("h", "q.h")}) END
            ), 1)), 1)), 1) END)""")


def _rounded(wanted: DataFrame, levels: int, seed: int) -> DataFrame:
    """Settle the fractional p of (source, chunk, id, row, size, p): source, id, row, size, p in {0, 1}."""
    parts, level_in = [], wanted
    for level in range(levels):
        folded = (
            level_in.groupBy("source", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("id", "row", "size", "p"))).alias("items"))
            .select("source", "chunk", _fold(level, seed).alias("f"))
        )
        parts.append(folded.select("source", F.explode("f.out").alias("i")))
        level_in = folded.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), "f.held.*")
    alone = F.expr(f"CASE WHEN {_uniform('id', level=levels, seed=seed)} < p THEN 1D ELSE 0D END")
    parts.append(level_in.select("source", F.struct("id", "row", "size", alone.alias("p")).alias("i")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("source", "i.*")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Per document: row, doc_id, source, size, source_size, target, copies, taken."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    return mix_rows(rows, **settings)


def mix_rows(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The same for rows that have a number: row, doc_id, source, text."""
    # one pass over the texts; all that follows moves a few numbers per document
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    sizes = staged(rows.select("row", "doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key")), "mix-sizes")
    targets = staged(source_targets(sizes, weights, share, cap), "mix-targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, most)) / math.log(CHUNK)))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    joined = sizes.alias("s").join(targets.alias("t"), same).select(
        "row", "doc_id", "key", "s.source", "size", "source_size", "n_docs", "target", F.floor(ratio).alias("sure"), (ratio - F.floor(ratio)).alias("p")
    )
    fractional = (F.col("size") > 0) & (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    # rows of one key share a chunk unless they are many
    many = staged(sizes.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.lit(True).alias("many")), "mix-many")
    salt = F.when(F.col("many"), F.xxhash64("row")).otherwise(F.lit(0))
    chunk = F.pmod(F.xxhash64("key", salt, F.lit(seed)), F.ceil(F.col("n_docs") / CHUNK))
    wanted = joined.where(fractional).join(F.broadcast(many) if can_broadcast(many) else many, "key", "left").select(
        "source", chunk.alias("chunk"), F.col("key").alias("id"), "row", "size", "p"
    )
    drawn = _rounded(wanted, levels, seed).select("row", F.col("p").cast("bigint").alias("extra"))
    copies = F.col("sure") + F.coalesce("extra", F.when(fractional, F.lit(0)).otherwise(F.round("p")).cast("bigint"))
    return joined.join(drawn, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken.

    The rows are numbered in a stored copy, to which the plan is joined.
    """
    rows = numbered(docs, "mix-rows")
    plan = mix_rows(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), **settings).where("copies > 0").select("row", "copies")
    return rows.join(plan, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
