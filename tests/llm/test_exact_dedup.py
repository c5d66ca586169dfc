import hashlib
import random
from collections import defaultdict

import pytest

from threadloom.llm.exact_dedup import PatriciaTrie, exact_duplicates, normalise


@pytest.mark.parametrize("budget", [1 << 30, 3000, 400])
def test_trie_groups_equal_strings_and_spills(budget):
    draw = random.Random(budget)
    keys = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 9))) * draw.choice([1, 1, 30]) for _ in range(3000)]
    trie = PatriciaTrie(budget)
    for i, k in enumerate(keys):
        trie.insert(k, i)
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    assert sorted(map(sorted, trie.terminals())) == sorted(want.values())
    assert (trie.spills > 0) == (budget < 1 << 30)


def test_long_shared_prefixes_spill_by_branch():
    keys = [b"x" * 5000 + bytes([c]) * 500 for c in range(97, 117)] * 2
    trie = PatriciaTrie(20_000)
    for i, k in enumerate(keys):
        trie.insert(k, i)
    assert sorted(map(sorted, trie.terminals())) == [[i, i + 20] for i in range(20)]


def test_against_brute_force(odd, odd_rows):
    for budget, fan in ((1 << 20, 64), (500, 64), (100, 1)):
        got = exact_duplicates(odd, budget, fan).collect()
        groups = defaultdict(list)
        for r in odd_rows:
            groups[normalise(r[1])].append(r[0])
        want = sorted(
            (str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(body).hexdigest())
            for body, ids in groups.items()
            for i in ids
        )
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty(empty):
    assert exact_duplicates(empty).count() == 0


def test_only_ascii_letters_fold(stored):
    got = {r.doc_id: r.group_size for r in exact_duplicates(stored([(1, "Ä"), (2, "ä"), (3, "AB"), (4, "ab")])).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_owners_of_a_hot_text_are_thinned_in_rounds(spark, tmp_path):
    from pyspark.sql import functions as F

    text = F.when(F.col("id") % 3 == 0, F.lit("the hot text, as long as it is " * 20)).otherwise(F.concat(F.lit("other "), F.col("id") % 5000))
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    want = {(r.keep_id, r.n) for r in docs.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).collect()}
    for budget, fan in ((1 << 20, 64), (2000, 3), (0, 8)):  # with no budget every row is an owner
        got = exact_duplicates(docs, budget, fan)
        rows = got.collect()
        assert {(r.keep_id, r.group_size) for r in rows} == want and len(rows) == 20_000
        assert sum(r.kept for r in rows) == len(want) and all((r.doc_id == r.keep_id) == r.kept for r in rows)
