"""Encoding by halves against the tiktoken library on whole texts, and the decoded bytes."""

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TINY = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, leaf=2, long=0)
CODECS = [TINY, byte_bpe.Codec(PATH, leaf=7), byte_bpe.Codec(PATH)]
PARTS = ["the", " The", "don't", "'s", "'ll", "''", " ", "  ", "   \n", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "1", "2024", "½", "a1", "!", "...", "---", "é", "É", "漢字", "。", "ʼ", "\U0001f600", "<|endoftext|>", "_", "aaaa", "ing", "\x00", "­", "ﬁ", "ǆ"]


def same(text):
    want = LIBRARY.encode_ordinary(text)
    for codec in CODECS:
        got = codec.encode(text)
        assert got.dtype == np.uint32 and got.tolist() == want, (codec.leaf, text)
        assert codec.decode(got) == text.encode()


def test_mixed_texts():
    draw = random.Random(12)
    for n in [0, 1, 2, 3, 5, 8, 20, 60, 300] * 60:
        same("".join(draw.choice(PARTS) for _ in range(n)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "thing", "aeiou st", "0", "0123456789", "-", "=*-", "漢字仮名", "é", "한국어", " ", " \n", "é ", "'s", "aA"])
def test_long_runs(alphabet):
    draw = random.Random(3)
    for n in (100, 1023, 5000):
        same("".join(draw.choice(alphabet) for _ in range(n)))
        same(" " + "".join(draw.choice(alphabet) for _ in range(n)) + " end.")


def test_pieces_are_joined_by_tokens(monkeypatch):
    """A run without borders is joined by small windows, not encoded as a whole at each level."""
    codec = byte_bpe.Codec(PATH, leaf=256)
    draw, sizes, kept = random.Random(8), [], codec._merged
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    monkeypatch.setattr(codec, "_merged", lambda raw: sizes.append(len(raw)) or kept(raw))
    assert codec.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    assert len(sizes) > 60 and sum(sizes) < 20_000


def test_join_is_associative():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice(PARTS) for _ in range(30))
        a, b = sorted(draw.sample(range(1, len(text)), 2))
        x, y, z = TINY.encode(text[:a]), TINY.encode(text[a:b]), TINY.encode(text[b:])
        left = TINY.join(text, 0, b, len(text), TINY.join(text, 0, a, b, x, y), z)
        right = TINY.join(text, 0, a, len(text), x, TINY.join(text, a, b, len(text), y, z))
        assert left.tolist() == right.tolist() == LIBRARY.encode_ordinary(text)


def test_neighbours_decide():
    """A sequence of tokens is an encoding if and only if each two neighbours are."""
    draw, ids = random.Random(6), list(RANKS.values())
    for _ in range(3000):
        tokens = [draw.choice(ids[:400]) for _ in range(draw.randrange(2, 6))]
        whole = TINY._plain(b"".join(TINY.bytes[t] for t in tokens)) == tokens
        assert whole == all(TINY._fit(a, b) for a, b in zip(tokens, tokens[1:]))


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Codec(PATH, r"\w+")


def digest(docs, got):
    assert sorted(r.doc_id or -1 for r in got) == sorted(d or -1 for d, _ in docs)
    want = sorted((d or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs for ids in [LIBRARY.encode_ordinary(t or "")])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_odd_and_empty(odd, odd_rows, empty):
    digest([(r[0], r[1]) for r in odd_rows], byte_bpe.round_trip(odd, PATH).collect())
    assert byte_bpe.round_trip(empty, PATH).count() == 0


def test_unknown_ids_are_errors():
    with pytest.raises(KeyError):
        TINY.decode(np.array([50256], np.uint32))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
def test_every_document(spark):
    from threadloom.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    digest([(r.doc_id, r.text) for r in docs], registry.QUERIES["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect())
