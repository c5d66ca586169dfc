import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadloom.llm import token_counts as C

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = [" ", "\n", "  ", "a", "'s", "é", " b c", "12", "...", "\n\n \t", "漢字", " I'll go", "<|endoftext|>"]


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits_count_as_a_full_encoding(full, leaf, monkeypatch):
    monkeypatch.setattr(C, "LEAF", leaf)
    counter, draw = C.TokenCounter(RANKS, most=50), random.Random(leaf)
    for _ in range(150):
        d = C.Document.of("".join(draw.choice(BITS) for _ in range(draw.randrange(300))), counter)
        for _ in range(5):
            a = draw.randrange(len(d.text) + 1)
            d.edit(a, a + draw.choice([0, 1, 3, 40]), "".join(draw.choice(BITS) for _ in range(draw.randrange(4))))
            assert d.tokens == full(d.text)


LONG = {
    "prose": "some plain words in a row " * 8000,
    "code": "for(i=0;i<n;i++){a[i]+=b[i]*c(i);}" * 6000,
    "indented": "def f(x):\n    if x:\n        return x[0]\n\n" * 5000,
    "json": '{"key":123,"list":[1,2,3],"t":"v"},' * 6000,
    "digits": "12 345 6789\n" * 17_000,
    "table": "1,2,3\n" * 30_000,
    "ideographs": "漢字 仮名。" * 30_000,
    "quotes": "'l'll''ve'x'" * 17_000,
    "spaces": "a  \n  b\t\t" * 20_000,
}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_an_edit_touches_few_pretokens(kind, full):
    counter, draw = C.TokenCounter(RANKS), random.Random(1)
    d, text = C.Document.of(LONG[kind], counter), LONG[kind]
    for _ in range(40):
        a, n, new = draw.randrange(len(text)), draw.choice([0, 1, 10]), draw.choice(["x", "", " 7", "\n", "'", "changed words"])
        text = text[:a] + new + text[a + n :]
        assert 0 < d.edit(a, a + n, new) <= 6 * C.LEAF
    assert d.text == text and d.tokens == full(text)


def test_one_long_pretoken(full):
    counter = C.TokenCounter(RANKS)
    d = C.Document.of("a" * 3000 + " " + "b " * 500, counter)
    d.edit(1500, 1500, " ")
    d.edit(2000, 2000, "1")
    assert d.tokens == full(d.text)
    d.edit(0, 10**9, "")
    assert (d.text, d.tokens, d.tree.n) == ("", 0, 1)
    d.edit(0, 0, "again some text")
    assert d.tokens == full("again some text")


def test_stored_states_are_used_not_remade(spark, full, stored, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, "word %d, " % i * (20 * i + 1)) for i in range(40)]
    state = C.count_tokens(stored(rows), RANKS, ("doc_id", "text"))
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("xyz 1").alias("new")))
    once = C.apply_edits(state.withColumn("edits", edits), RANKS)
    again = once.select("doc_id", F.col("text_after").alias("text"), "leaf_chars", "leaf_tokens").withColumn("edits", edits)
    for r in C.apply_edits(again, RANKS).collect():
        assert r.n_tokens_after == full(r.text_after) and r.n_pretokens_encoded <= 4 * C.LEAF
    # tokens of the leaves that no edit touches are those stored, whatever they are
    wrong = state.where("doc_id = 39").withColumn("leaf_tokens", F.transform("leaf_tokens", lambda x: x + 1000)).withColumn("edits", edits)
    r = C.apply_edits(wrong, RANKS).first()
    assert r.n_tokens_after > 1000 * (r.n_leaves - 4)
    with pytest.raises(Exception, match="not that of a text"):
        C.apply_edits(state.withColumn("text", F.lit("x")).withColumn("edits", edits), RANKS).collect()


def test_tree_sums():
    import numpy as np

    leaves = np.array([[3, 1], [4, 2], [5, 3], [1, 1], [2, 2]])
    t = C.SumTree(leaves)
    assert t.total == 9 and t.leaf_at(0) == (0, 0) and t.leaf_at(7) == (2, 7) and t.leaf_at(99) == (4, 13)
    assert t.replace(1, 2, np.array([[9, 9]])).total == 16
    assert t.replace(0, 5, np.array([[1, 1]])).total == 1


def test_tables(full, odd, empty, odd_rows):
    got = C.count_tokens(odd, RANKS).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), full(r[1] or "")) for r in odd_rows)
    assert all(sum(r.leaf_tokens) == r.n_tokens for r in got)
    edited = odd.select("doc_id", "text", C.sample_edits(odd["text"]).alias("edits"))
    for r in C.count_edited(edited, RANKS).collect():
        assert r.n_tokens_after == full(r.text_after)
    assert C.count_tokens(empty, RANKS).count() == 0


def test_null_edits(odd):
    from pyspark.sql import functions as F

    rows = C.count_edited(odd.withColumn("edits", F.lit(None).cast("array<struct<start: int, end: int, new: string>>")), RANKS).collect()
    assert all(r.n_tokens == r.n_tokens_after for r in rows)
