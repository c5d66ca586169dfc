"""Collocations against a plain count of all phrases, whatever the blocks, and exact scores beyond 64 bits."""

import random
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadloom.llm import collocations, staging

COLUMNS = "lang rank phrase a l r n score".split()


def plain(rows, least, longest=4, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(table, **given):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(table, **given).collect())


def make_rows(n=260):
    draw = random.Random(2)
    words = ["The", "the", "of", "new", "york", "city", "é", "É", "x y", "漢字", "a", "b"]
    stock = ["new york city", "of the new york city of", "a a a a a a", "b a b a b", "new\tyork  city"]
    rows = []
    for _ in range(n):
        parts = [draw.choice(stock) if draw.random() < 0.4 else draw.choice(words) for _ in range(draw.randrange(0, 25))]
        rows.append(("".join(p + draw.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ? "]) for p in parts), draw.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("...", "zz"), ("lonely", "fr")]


@pytest.mark.parametrize("block, most", [(1 << 22, 1 << 26), (300, 1 << 26), (300, 0), (1 << 22, 3000)])
def test_equals_plain_counts(stored, block, most):
    rows = make_rows()
    table = stored(rows, "text string, lang string")
    want = plain(rows, 20)
    assert mined(table, least=20, chars=block, most=most) == want and {len(r[2].split()) for r in want} >= {2, 3, 4}
    assert mined(table, least=20, top=3) == plain(rows, 20, top=3)


def test_blocks_hold_all_words(stored):
    rows = make_rows(60)
    blocks = collocations.word_blocks(stored(rows, "text string, lang string"), 200).collect()
    assert len(blocks) > 20
    got = Counter()
    for b in blocks:
        got.update({(b.lang, w): n for w, n in zip(b.words, b.counts)})
        assert "" not in b.words and not any(c in w for w in b.words for c in ".,;:!?\n\r\x0b\x0c \t")
    want = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        want.update((lang or "und", w) for w in re.split(r"[.,;:!?\x0A-\x0D \t]+", low) if w)
    assert got == want


def test_long_texts_are_cut_between_pieces(stored):
    draw = random.Random(7)
    text = "".join(draw.choice(["Alpha beta", " ", "gamma", "\t", ".", ",", "\n", " delta  x"]) for _ in range(6000))
    table = stored([(text, "en"), ("w " * 3000, "en"), ("short", "de")], "text string, lang string")
    blocks = collocations.word_blocks(table, 500).collect()
    assert len(blocks) > 20 and max(sum(b.counts) for b in blocks) == 3000
    assert mined(table, least=40, chars=500) == plain([(text, "en"), ("w " * 3000, "en"), ("short", "de")], 40)


def test_one_phrase_on_a_third_of_all_rows(stored):
    rows = [("hot phrase here", "en")] * 2000 + [(f"w{i} v{i} u{i}", "en") for i in range(4000)]
    assert mined(stored(rows, "text string, lang string", 8)) == [("en", 1, "hot phrase here", 2000, 2000, 2000, 18000, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    a, b, c = 9 * 10**17, 9 * 10**18, 9 * 10**18 - 1
    row = spark.createDataFrame([([a, b], [c, a], a)], "starts array<bigint>, ends array<bigint>, f bigint")
    l, r, score = collocations.cuts(3)
    want = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate([(a, a), (b, c)]))
    assert row.select(l, r, score).first() == (want[2], want[3], want[0])
    tie = spark.createDataFrame([([70, 50], [50, 70], 30)], "starts array<bigint>, ends array<bigint>, f bigint")
    assert tie.select(*collocations.cuts(3)).first() == (70, 70, 428571)


def test_odd_and_empty(odd, odd_rows, empty):
    assert mined(odd, least=2) == plain([(r[1], r[2]) for r in odd_rows], 2)
    assert mined(empty) == []


def test_row_groups_of_large_rows_are_small(spark, tmp_path):
    rows = spark.range(0, 90, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.xxhash64("id", k)).alias("ids"))
    assert staging.staged(rows, "", str(tmp_path / "t"), 1 << 20).agg(F.sum(F.size("ids"))).first()[0] == 1_800_000
    meta = pq.ParquetFile(next(Path(tmp_path / "t").glob("*.parquet"))).metadata
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert len(sizes) >= 6 and max(sizes) < 3 << 20


def test_blocks_are_stored_in_small_row_groups(stored, monkeypatch):
    given = []
    monkeypatch.setattr(collocations, "staged", lambda df, name, path=None, group=None: given.append(group) or staging.staged(df, name, path, group))
    collocations.frequent_phrases(stored(make_rows(30), "text string, lang string"), 5)
    assert given.count(collocations.GROUP_BYTES) == 4
