import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import simple8b
from threadloom.llm.token_output import WordCache, known_parts, read_token_files, token_output, write_token_files

TABLES = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    assert simple8b.decode(simple8b.encode(np.array(ids, np.uint64))).tolist() == ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**20, 2**60, 2**64 - 1])
def test_simple8b_sizes(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(x)) == x).all()


def test_runs_of_zeros_are_dense():
    assert len(simple8b.encode(np.zeros(5120, np.uint64))) < 400


def test_cache_equals_the_library():
    cache, plain = WordCache(FILE, most=50), Tokenizer.from_file(FILE)
    texts = ["Hello, World. It's I'LL don't, 3, 4. ..., a_. x&&& É. ß, ÿ", "Σ İ 漢字 ﬁ", "<|endoftext|> A", "", "\x1c. \x85,  ", "a\tb\nc.\n", "K Å ǅ", "foo### bar,%%% (baz). 'quoted', \"x\"."]
    for _ in range(3):
        ids, counts = cache.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_texts_equal_the_library():
    draw = random.Random(8)
    parts = ["the", "éèle", "ªº", "µm", "ÿ", "ß", "ß.", "Éa", "a\u0301", "12", "x1", "'s", "don't", "%%%", ".", ",", "...", "(a)", "漢", "Σ", "ﬁ", "\xad", "a\xadb", "\xa0", "\x85", "×", "÷", "_", "²", "½", "<|", "\t", "ñandú,", "über;", "\u0130", "ô!!"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", " ", "", "\n", "  "]) for _ in range(draw.randrange(1, 30))) for _ in range(3000)]
    cache, plain = WordCache(FILE, most=500), Tokenizer.from_file(FILE)
    ids, counts = cache.encode(texts)
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_other_tokenizers_encode_whole_texts():
    file = public_tokenizers.path("byte_bpe_50k.json")
    cache, plain = WordCache(file), Tokenizer.from_file(file)
    assert not cache.by_words and WordCache(FILE).by_words
    texts = ["Hello, World. It's", "", "a  b\n\nc É 漢字", "x"]
    ids, counts = cache.encode(texts, (2,))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert cache.encode([])[1].tolist() == []


@pytest.mark.parametrize("part, value", [("normalizer", None), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]}), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 5}), ("added_tokens", [{"content": "foo", "lstrip": False, "rstrip": False, "normalized": False, "single_word": False}])])
def test_each_part_is_checked(part, value):
    with open(FILE, encoding="utf-8") as file:
        tokenizer = json.load(file)
    assert known_parts(tokenizer) and not known_parts(tokenizer | {part: value})
    assert not known_parts(tokenizer | {"model": tokenizer["model"] | {"end_of_word_suffix": "@@"}})


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the synthetic tables")
def test_every_document_of_a_table_equals_its_whole_text(spark):
    plain = Tokenizer.from_file(FILE)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output(spark.read.parquet(f"{TABLES}/documents.parquet"), FILE).collect()}
    ids = [e.ids + [2] for e in plain.encode_batch_fast([t or "" for _, t in docs], add_special_tokens=False)]
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(docs, ids)} and len(got) > 900


def test_one_id_fills_several_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(5).alias("doc_id"), F.lit("same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one partition
    try:
        write_token_files(docs, str(tmp_path / "files"), FILE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r.n for r in spark.read.parquet(str(tmp_path / "files")).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(per) > 1 and max(per) < 12_000 and sum(per) == 20_000
    read = read_token_files(spark, str(tmp_path / "files"))
    assert read.where("doc_id is null").agg(F.max("start")).first()[0] < read.where("doc_id = 5").agg(F.min("start")).first()[0]


def _expected(rows):
    plain, start, out = Tokenizer.from_file(FILE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(odd, empty, odd_rows):
    got = sorted(map(tuple, token_output(odd, FILE).collect()), key=lambda r: r[1])
    want = _expected([r[:2] for r in odd_rows])
    assert [g[1:] for g in got if g[0] not in (None, 9)] == [w[1:] for w in want if w[0] not in (None, 9)]
    assert sorted(g[2:] for g in got) == sorted(w[2:] for w in want)
    assert token_output(empty, FILE).count() == 0


def test_read_detects_damage(spark, stored, tmp_path):
    path = str(tmp_path / "files")
    write_token_files(stored([(1, "a b c"), (2, "d")]), path, FILE)
    good = spark.read.parquet(path)
    bad = good.withColumn("n_ids", good["n_ids"] + 1)
    bad.write.parquet(path + "-bad")
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, path + "-bad").collect()
