"""Phrase collocations: frequent phrases of 2 to 4 words by hierarchical pair naming.

Texts become blocks of word codes (about ``BLOCK_CHARS`` characters of one language; longer
texts are cut, but only between pieces). On level 1 the words of all blocks are counted, those that occur
``LEAST`` times get an id, and each block learns the ids of its own words. On level k two
neighbouring (k-1)-gram ids of a block, which overlap in k-2 words, are a pair; pairs are
counted over all blocks, frequent ones get an id (joined globally) and replace the ids in
the blocks. A k-gram can only be frequent if both its (k-1)-grams are, so nothing is lost,
and a k-gram's pair is its two parent pointers: the ids of all its beginnings and ends, which
cuts need, are those of its parents and its parents' parents.

A block counts its own pairs first, so each key has one row per block at most before the
shuffle, however often it occurs: no word is hot. Names of at most ``BROADCAST_BYTES``, as
counted, are sent to all tasks; more of them are joined by key with the pairs of the blocks, and
what goes back to a block are the ids of its own pairs, bounded by its size. A longer phrase is never more frequent than the
phrases in it, so a phrase that some longer one subsumes is also subsumed by one with one
word more, and only those are looked at.

Counts are exact; scores are decimals of 38 digits, so products may pass 64 bits.

Edge cases: null texts are empty, null languages are ``und`` (with those that are so
called); doc_ids and other columns are not looked at; repeated rows count as often as they
occur; an empty table gives an empty result; equal scores and counts are ordered by the
phrase's bytes. A text without separators is one piece and stays in one block, whatever its
length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import BROADCAST_BYTES, GROUP_BYTES, byte_batches, can_broadcast, new_path, remove, shuffles_dropped, staged
from .worker import map_arrow

LEAST, LONGEST, TOP, SALTS = 30, 4, 2000, 16
#: A block is closed at so many characters, and the largest one when all open ones have so many.
BLOCK_CHARS, OPEN_CHARS = 1 << 22, 1 << 23
#: Bytes of an Arrow batch of blocks: a block is some megabytes.
BATCH_BYTES = 1 << 24
SEPARATORS = r"[.,;:!?\n\x{0B}\x{0C}\r]"
_SEPARATOR = re.compile(r"[.,;:!?\x0A-\x0D]")
#: Stands between pieces and texts; it is a separator, so no word is equal to it.
GAP = "\n"

_WORDS = "lang string, words array<string>, counts array<bigint>, codes binary"
_BLOCK = "block bigint, codes binary, ids array<bigint>"
_PAIRS = "a bigint, b bigint, n bigint"
_PLACES = "block bigint, place int, a bigint, b bigint"


def _words(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the code of each word in order, -1 between pieces."""
    joined = pa.chunked_array(texts, pa.large_string()).combine_chunks()
    cut = pc.replace_substring_regex(pc.ascii_lower(joined), pattern=SEPARATORS, replacement=f" {GAP} ")
    ends = [pa.scalar(x, pa.large_string()) for x in (GAP, " ")]
    cut = pc.binary_join_element_wise(pc.replace_substring(cut, pattern="\t", replacement=" "), *ends)
    coded = pc.split_pattern(cut, " ").flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    no_word = pc.or_(pc.equal(words, ""), pc.equal(words, GAP)).to_numpy(zero_copy_only=False)
    gap = pc.equal(words, GAP).to_numpy(zero_copy_only=False)
    codes = codes[(~no_word | gap)[codes]]
    number = np.where(no_word, -1, np.cumsum(~no_word) - 1).astype(np.int32)
    return words.filter(pa.array(~no_word)), number[codes]


def _segments(texts: pa.Array, most: int) -> pa.Array:
    """Texts with those longer than ``most`` characters cut at separators, into parts of about that many."""
    if not len(texts) or pc.max(pc.utf8_length(texts)).as_py() <= most:
        return texts
    out = []
    for text in texts.to_pylist():
        begin = 0
        while cut := _SEPARATOR.search(text, begin + most):
            out.append(text[begin : cut.start()])
            begin = cut.end()
        out.append(text[begin:])
    return pa.array(out, pa.large_string())


def _block_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}

    def closed(lang: str) -> pa.RecordBatch:
        sizes.pop(lang)
        words, codes = _words(held.pop(lang))
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        lists = [pa.array([x.to_pylist()], pa.list_(kind)) for x, kind in ((words, pa.string()), (pa.array(counts), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *lists, pa.array([codes.tobytes()], pa.binary())], names=["lang", "words", "counts", "codes"])

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        for lang in pc.unique(langs).to_pylist():
            own = _segments(texts.filter(pc.equal(langs, lang)), most)
            chars = pc.binary_length(own).to_numpy()
            begin = 0
            while begin < len(own):  # a long batch fills several blocks
                room = most - sizes.get(lang, 0)
                end = begin + max(1, int(np.searchsorted(np.cumsum(chars[begin:]), room, side="right")))
                held.setdefault(lang, []).append(own.slice(begin, end - begin))
                sizes[lang] = sizes.get(lang, 0) + int(chars[begin:end].sum())
                begin = end
                if sizes[lang] >= most or begin < len(own):
                    yield closed(lang)
        while sum(sizes.values()) > OPEN_CHARS:
            yield closed(max(sizes, key=sizes.get))
    for lang in sorted(sizes):
        yield closed(lang)


def word_blocks(docs: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """block, lang, words (distinct), counts and codes (int32, -1 between pieces) of all texts; blocks are numbered when they are stored."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    made = map_arrow(texts, lambda it: _block_rows(it, chars), _WORDS)
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def _pairs(codes: bytes, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place of the key at each position or -1, their positions, counts) of neighbouring known codes."""
    c = np.frombuffer(codes, np.int32)
    at = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0))
    keys, place, counts = np.unique(c[at].astype(np.int64) * max(many, 1) + c[at + 1], return_inverse=True, return_counts=True)
    return keys, place, at, counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, ids in zip(batch.column(0), batch.column(1)):
            ids = ids.values.to_numpy(zero_copy_only=False)
            keys, _, _, counts = _pairs(codes.as_py(), len(ids))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(ids[keys // len(ids)]), pa.array(ids[keys % len(ids)]), pa.array(counts)], names=["a", "b", "n"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, ids in zip(*(batch.column(k) for k in range(3))):
            ids = ids.values.to_numpy(zero_copy_only=False)
            keys, _, _, _ = _pairs(codes.as_py(), len(ids))
            if len(keys):
                cols = [np.full(len(keys), block.as_py()), np.arange(len(keys), dtype=np.int32), ids[keys // len(ids)], ids[keys % len(ids)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "place", "a", "b"])


def _block(number: int, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([number], pa.int64()), pa.array([codes.astype(np.int32).tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["block", "codes", "ids"])


def _renamed(number: int, codes: bytes, at: np.ndarray | None, inverse: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The block of the next level: ``ids`` has the id of each distinct key, -1 where it has none.

    ``inverse`` has the key at each position (of ``at``, all positions without it); -1 is a gap.
    """
    local = np.where(ids >= 0, np.cumsum(ids >= 0) - 1, -1).astype(np.int32)
    local = np.append(local, np.int32(-1))
    if at is None:
        return _block(number, local[inverse], ids[ids >= 0])
    out = np.full(max(len(codes) // 4 - 1, 0), -1, np.int32)
    out[at] = local[inverse]
    return _block(number, out, ids[ids >= 0])


class WordNames:
    """Ids of words by language, small enough to be sent to all tasks."""

    def __init__(self, names: pa.Table):
        names = names.combine_chunks()
        self.by_lang = {x: names.filter(pc.equal(names["lang"], x)).select(["word", "id"]).combine_chunks() for x in pc.unique(names["lang"]).to_pylist()}

    def blocks(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Blocks of ids from blocks of words."""
        for k in range(batch.num_rows):
            words, own = batch["words"][k].values, self.by_lang.get(batch["lang"][k].as_py())
            ids = np.full(len(words), -1, np.int64)
            if own is not None and len(words):
                found = pc.index_in(words, own["word"].combine_chunks())
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                ids[hit] = own["id"].to_numpy()[found.drop_null().to_numpy()]
            codes = batch["codes"][k].as_py()
            yield _renamed(batch["block"][k].as_py(), codes, None, np.frombuffer(codes, np.int32), ids)


class PairNames:
    """Ids of pairs, small enough to be sent to all tasks."""

    def __init__(self, names: pa.Table):
        a, b, ids = (names[c].to_numpy() for c in ("a", "b", "id"))
        self.parts = np.unique(np.concatenate([a, b]))
        keys = np.searchsorted(self.parts, a) * len(self.parts) + np.searchsorted(self.parts, b)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def blocks(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Blocks of the next level."""
        for k in range(batch.num_rows):
            codes, known = batch["codes"][k].as_py(), batch["ids"][k].values.to_numpy(zero_copy_only=False)
            keys, inverse, at, _ = _pairs(codes, len(known))
            ids = np.full(len(keys), -1, np.int64)
            if len(keys) and len(self.keys):
                part = np.minimum(np.searchsorted(self.parts, known), len(self.parts) - 1)
                part = np.where(self.parts[part] == known, part, -1)
                x, y = part[keys // len(known)], part[keys % len(known)]
                wanted = x * len(self.parts) + y
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = (x >= 0) & (y >= 0) & (self.keys[found] == wanted)
                ids[hit] = self.ids[found[hit]]
            yield _renamed(batch["block"][k].as_py(), codes, at, inverse, ids)


def _joined(block: pa.Table, named: pa.Table) -> pa.Table:
    """One block of words or pairs with the ids of its places: the block of the next level."""
    codes, pairs = block["codes"][0].as_py(), block["ids"][0].as_py() is not None
    if pairs:
        keys, inverse, at, _ = _pairs(codes, len(block["ids"][0]))
        ids = np.full(len(keys), -1, np.int64)
    else:
        ids, at, inverse = np.full(block["many"][0].as_py(), -1, np.int64), None, np.frombuffer(codes, np.int32)
    ids[named["place"].to_numpy()] = named["id"].to_numpy()
    return pa.Table.from_batches([_renamed(block["block"][0].as_py(), codes, at, inverse, ids)])


def _rename(blocks: DataFrame, names: DataFrame, level: int, most: int) -> DataFrame:
    """Blocks in which each word (level 1) or pair has the id that ``names`` has for it; without an id it is a gap.

    Names of at most ``most`` bytes, as counted, go to all tasks. Otherwise each block asks for
    its own keys by a join, one row per block and key, and gets its answers back.
    """
    if can_broadcast(names, most):
        shared = names.sparkSession.sparkContext.broadcast((WordNames if level == 1 else PairNames)(names.toArrow()))
        return map_arrow(blocks, lambda it: (made for batch in it for made in shared.value.blocks(batch)), _BLOCK)
    if level == 1:
        places, on = blocks.select("block", "lang", F.posexplode("words").alias("place", "word")), ["lang", "word"]
        blocks = blocks.select("block", "codes", F.size("words").alias("many"), F.lit(None).cast("array<bigint>").alias("ids"))
    else:
        places, on = map_arrow(blocks, _placed, _PLACES), ["a", "b"]
    hits = places.join(names, on).select(F.col("block").alias("own"), "place", "id")
    return blocks.groupBy("block").cogroup(hits.groupBy("own")).applyInArrow(_joined, _BLOCK)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chars: int = BLOCK_CHARS, most: int = BROADCAST_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """(tables of frequent phrases by number of words from 1 on, words per language).

    A table has id, lang, phrase, last (word), f, starts and ends (frequencies of its
    beginnings and ends by number of words) and, from two words on, a and b: the ids of
    its two parents, the phrase without its last and without its first word. ``chars``
    and ``most`` (see ``_rename``) change no result.
    """
    spark = docs.sparkSession
    paths = [new_path(spark, f"collocation-blocks{level}") for level in range(longest)]
    blocks = staged(word_blocks(docs, chars), "", paths[0], GROUP_BYTES)
    entry = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    totals = staged(entry.groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals")
    none = F.array().cast("array<bigint>")
    counted = entry.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    named = counted.select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("starts"), none.alias("ends"))
    levels = [staged(named, "collocation-words")]
    for level in range(2, longest + 1):
        names = levels[0].select("id", "lang", F.col("phrase").alias("word")) if level == 2 else levels[-1].select("id", "a", "b")
        renamed = _rename(blocks, names, level - 1, most)
        with byte_batches(spark, BATCH_BYTES):
            blocks = staged(renamed, "", paths[level - 1], GROUP_BYTES)
        remove(spark, paths[level - 2])
        pairs = map_arrow(blocks.select("codes", "ids"), _counted, _PAIRS)
        many = pairs.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        phrases = _phrases(many, levels[-1])
        with byte_batches(spark, BATCH_BYTES):
            levels.append(staged(phrases, f"collocation-phrases{level}"))
    remove(spark, paths[-1])
    return levels, totals


def _phrases(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent pairs (a, b, f) with what their two parents know."""
    left = shorter.select(F.col("id").alias("a"), "lang", "phrase", F.col("starts").alias("a_starts"), F.col("f").alias("a_f"))
    right = shorter.select(F.col("id").alias("b"), "last", F.col("ends").alias("b_ends"), F.col("f").alias("b_f"))
    both = pairs.join(F.broadcast(left) if can_broadcast(shorter) else left, "a").join(F.broadcast(right) if can_broadcast(shorter) else right, "b")
    grown = lambda old, f: F.concat(F.col(old), F.array(f))
    return both.select(
        F.monotonically_increasing_id().alias("id"), "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
        grown("a_starts", "a_f").alias("starts"), grown("b_ends", "b_f").alias("ends"), "a", "b",
    )


def cuts(words: int) -> tuple[Column, Column, Column]:
    """(l, r, score) of the worst cut of a phrase of ``words`` words, the first of equals."""
    exact = lambda c: c.cast("decimal(20,0)")

    def cut(k: int) -> Column:
        l, r = F.col("starts")[k - 1], F.col("ends")[words - k - 1]
        score = F.call_function("div", exact(F.col("f")) * F.lit(2_000_000).cast("decimal(8,0)"), exact(l) + exact(r))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    worst = F.least(*[cut(k) for k in range(1, words)]) if words > 2 else cut(1)
    return worst["l"], worst["r"], worst["score"]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chars: int = BLOCK_CHARS, most: int = BROADCAST_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score."""
    with shuffles_dropped(docs.sparkSession):
        levels, totals = frequent_phrases(docs, least, longest, chars, most)
    kept = None
    for words in range(2, longest + 1):
        own = levels[words - 1]
        l, r, score = cuts(words)
        scored = own.select("id", "lang", "phrase", F.col("f").alias("a"), l.alias("l"), r.alias("r"), score.alias("score"))
        if words < longest:
            longer = levels[words]
            inside = longer.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("within"))
            wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
            scored = scored.join(inside, "id", "left").where(F.col("within").isNull() | (wide("within", 100) < wide("a", 80))).drop("within")
        part = scored.drop("id")
        kept = part if kept is None else kept.unionByName(part)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if can_broadcast(totals) else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = "\n".join(
    f"""UNION ALL SELECT lang, {k} AS k, {" || ' ' || ".join(f"w[i + {j}]" for j in range(k))} AS phrase, w[i] AS w1,
{", ".join(f"w[i + {j}] AS w{j + 1}" if j < k else f"NULL AS w{j + 1}" for j in range(1, 4))} FROM spot WHERE i + {k - 1} <= len(w)"""
    for k in range(2, 5)
)
ORACLE_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS t
  FROM documents
), row_ AS (SELECT lang, list_filter(string_split_regex(t, '[ \t]+'), lambda x: x <> '') AS w FROM piece),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM row_),
gram AS (SELECT lang, 1 AS k, w[i] AS phrase, w[i] AS w1, NULL AS w2, NULL AS w3, NULL AS w4 FROM spot {_GRAMS}),
f AS (SELECT lang, k, phrase, w1, w2, w3, w4, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j,
    array_to_string([c.w1, c.w2, c.w3, c.w4][1:j], ' ') AS head, array_to_string([c.w1, c.w2, c.w3, c.w4][j + 1:c.k], ' ') AS tail
  FROM cand c, unnest([1, 2, 3]) u(j) WHERE j < c.k
), scored AS (
  SELECT cut.*, l.f AS l, r.f AS r, (2000000::HUGEINT * cut.a) // (l.f + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN cand b ON s.lang = b.lang AND b.k > s.k AND s.w1 IN (b.w1, b.w2, b.w3)
    AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * b.f >= 80::HUGEINT * s.f
), kept AS (SELECT worst.* FROM worst ANTI JOIN inside USING (lang, phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
