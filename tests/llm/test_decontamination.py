import random

import pytest

from threadloom.llm import decontamination as D
from threadloom.llm.textops import word_hashes


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_edit_distance_is_exact():
    draw = random.Random(3)
    for _ in range(1500):
        a = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        b = [draw.randrange(4) for _ in range(draw.randrange(20))]
        d = distance(a, b)
        assert D.edit_distance_within(a, b, d) == d
        assert D.edit_distance_within(a, b, d - 1) is None


def _corpus(seed=0):
    draw = random.Random(seed)
    common = ["the", "of", "and", "in"]
    word = lambda: draw.choice(common) if draw.random() < 0.4 else "".join(draw.choice("abcde") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 9, 12, 15, 20, 30, 45, 60] * 4)]
    docs = []
    for k in range(150):
        words = [word() for _ in range(draw.choice([0, 20, 200]))]
        if k % 2:
            item = draw.choice(items)[1].split()
            for _ in range(draw.randrange(D.allowed(len(item)) + 2)):
                p, what = draw.randrange(len(item)), draw.randrange(3)
                if what == 0:
                    item[p] = word()
                elif what == 1:
                    item.insert(p, word())
                elif len(item) > 1:
                    del item[p]
            at = draw.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((k, " ".join(words).upper() if k % 3 else ", ".join(words)))
    return items, docs


def test_equals_brute_force(stored):
    items, docs = _corpus()
    found = D.find_leaks(stored(docs), stored(items, "item_id bigint, text string"))
    got = {(r.doc_id, i) for r in found.collect() for i in r.item_ids}
    hashed = lambda t: word_hashes([t])[0].tolist()
    want = set()
    for i, t in items:
        item = hashed(t)
        for k, d in docs:
            if distance(item, hashed(d)) <= D.allowed(len(item)):
                want.add((k, i))
    assert not got - want
    assert len(got & want) >= 0.98 * len(want) and len(want) > 60


def test_blocks_of_items_give_the_same(stored):
    items, docs = _corpus(1)
    d, b = stored(docs), stored(items, "item_id bigint, text string")
    one, many = (sorted((r.doc_id, tuple(r.item_ids), r.contaminated) for r in D.find_leaks(d, b, block_chars=n).collect()) for n in (1 << 20, 900))
    assert one == many


def test_odd_and_empty(spark, odd, empty, odd_rows, stored):
    items = stored([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x"), (4, "zeta alpha beta gamma"), (4, "zeta alpha beta gamma")], "item_id bigint, text string")
    got = D.find_leaks(odd, items).collect()
    assert len(got) == len(odd_rows)
    assert {(r.doc_id, tuple(r.item_ids)) for r in got if r.contaminated} == {(1, (1,)), (2, (1,)), (7, (4, 4)), (8, (4, 4))}
    assert D.find_leaks(empty, items).count() == 0
    none = items.where("false")
    assert not D.find_leaks(odd, none).where("contaminated").count()
    assert D.clean_documents(odd, items).count() == len(odd_rows) - 4 and D.clean_documents(odd, items).columns == odd.columns


def test_long_items_do_not_hide_short_ones():
    word = lambda k, j: f"w{k}x{j}"
    short = [" ".join(word(k, j) for j in range(15)) for k in range(4)]
    long = [" ".join(word(k, j) for j in range(60)) for k in range(100, 400)]
    alone, mixed = D.ItemIndex(short), D.ItemIndex(short + long)
    assert len(mixed.walks) >= len(alone.walks) > 2


def test_too_few_walks_are_an_error(monkeypatch):
    monkeypatch.setattr(D, "MOST_WALKS", 1)
    with pytest.raises(ValueError, match="15 words"):
        D.ItemIndex([" ".join(f"w{j}" for j in range(15))])


def test_measured_recall_reaches_the_target():
    items = [" ".join(f"w{n}x{j}" for j in range(n)) for n in (5, 6, 8, 11, 14, 15, 19, 25, 40, 80)]
    measured = D.ItemIndex(items).measured
    assert {5, 15} <= set(measured) and all(walks >= 2 and found >= D.RECALL for walks, found in measured.values())


def test_an_index_that_is_too_large_is_divided(stored):
    items, docs = _corpus(2)
    d, b = stored(docs), stored(items, "item_id bigint, text string")
    assert len(list(D._indexes(items, D.SIMILARITY, D.RECALL, 9000))) > 3
    one, many = (sorted((r.doc_id, tuple(r.item_ids)) for r in D.find_leaks(d, b, index_bytes=n).collect()) for n in (1 << 30, 9000))
    assert one == many
    dirty = {i for i, hits in one if hits}
    assert {r.doc_id for r in D.clean_documents(d, b, index_bytes=9000).collect()} == {i for i, _ in docs} - dirty


def test_items_without_id_count(stored):
    items = [(None, "one two three four"), (7, "five six seven"), (None, "eight nine ten"), (8, None)]
    docs = [(1, "x one two three four y"), (2, "five six seven eight nine ten"), (3, "none")]
    for chars in (D.BLOCK_CHARS, 20):
        found = D.find_leaks(stored(docs), stored(items, "item_id bigint, text string"), block_chars=chars)
        assert {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in found.collect()} == {1: (True, 1, [None]), 2: (True, 2, [7, None]), 3: (False, 0, [])}
