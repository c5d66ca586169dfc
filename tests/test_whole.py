"""Queries over whole texts against brute force, beside their SQL twins."""

import random
import unicodedata

import pytest

from threadloom.plans import registry

draw = random.Random(7)
WORDS = ["alpha", "beta", "Gamma", "delta", "straße", "日本", "x1"]
TURNS = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(draw.choice(WORDS) + draw.choice(["", ",", "."]) for _ in range(draw.choice([1, 3, 60])))) for c in range(6) for t in range(8)]

ITEMS = [(0, TURNS[0][3] + " end"), (1, max((x for *_, x in TURNS), key=len)), (2, " ".join(draw.choice(WORDS) for _ in range(40))), (3, "abcdefgh " * 5 + TURNS[9][3])]


def strip(text):
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_ngrams(spark, tables):
    got = {(int(r.session_id), r.seq): r.grams for r in registry.QUERIES["ngrams"](spark, tables).collect()}
    assert got == {(c, t): " ".join(strip(x)[i : i + 3] for i in range(len(strip(x)) - 2)) for c, t, _, x in TURNS}
    assert max(map(len, got.values())) > 4 * 40


def test_distinct_ngrams(spark, tables):
    got = {(int(r.session_id), r.seq): (r.n, r.grams) for r in registry.QUERIES["distinct_ngrams"](spark, tables).collect()}
    want = {(c, t): sorted({strip(x)[i : i + 2] for i in range(len(strip(x)) - 1)}) for c, t, _, x in TURNS}
    assert got == {k: (len(g), " ".join(g)) for k, g in want.items()}


def test_fuzzy_batch(spark, tables):
    docs = [(k + 1, x, strip(x)) for k, (_, _, _, x) in enumerate(sorted(TURNS))]
    grams = lambda q, n: {q[i : i + n] for i in range(len(q) - n + 1)}
    want = {}
    for item, text in ITEMS:
        q, scores = strip(text), []
        two, three = grams(q, 2), grams(q, 3)
        for rowid, raw, norm in docs:
            p = norm[:1000]
            s = 0.7 * sum(g in p for g in two) / len(two) + 0.3 * sum(g in p for g in three) / len(three)
            near = any(g.lower() in norm.lower() for g in three) or any(g.lower() in raw.lower() for g in two)
            if near and s >= 0.15:
                scores.append((-round(max(s, 0.9) if q in p else s, 6), rowid))
        want |= {(item, r): (k + 1, -s) for k, (s, r) in enumerate(sorted(scores)[:20])}
    got = {(r.qid, r.rowid): (r.rank, r.score) for r in registry.QUERIES["fuzzy_batch"](spark, tables).collect()}
    assert got == want and {k for k, _ in got} == {0, 1, 2, 3}
    assert any(s == 1 or s >= 0.9 for _, s in got.values())


def test_all_pieces_and_ids(spark, tables):
    for name, column in (("wordpiece", "tokens"), ("encode", "ids")):
        got = registry.QUERIES[name](spark, tables).collect()
        assert all(len(r[column].split(" ")) == r.n for r in got) and max(r.n for r in got) > 100


def test_anchors_of_whole_sessions(spark, tables):
    got = {}
    for r in registry.QUERIES["anchor_fragments"](spark, tables).collect():
        got.setdefault(int(r.session_id), {})[r["rank"]] = r.seq
    own = {c: sorted((t for d, t, role, _ in TURNS if d == c and role == "user"), key=lambda t: (-len(strip_spaces(c, t)), t))[:3] for c in range(6)}
    assert {c: [v[k] for k in sorted(v)] for c, v in got.items()} == own
    assert max(t for v in own.values() for t in v) > 4
    assert registry.QUERIES["anchor_text"](spark, tables).count() == 6


def strip_spaces(c, t):
    return next(" ".join(x.split()) for d, u, _, x in TURNS if (d, u) == (c, t))
