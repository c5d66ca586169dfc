import random
import zlib

from threadloom.llm import language_id


def make_rows(n=400):
    draw = random.Random(0)
    words = {"en": ["the", "of", "tion", "and", "ing"], "de": ["der", "und", "ich", "schön", "keit"], "es": ["ción", "los", "que", "ñas", "para"]}
    return [(i, " ".join(draw.choice(words[lang]) for _ in range(draw.randrange(3, 60))), lang) for i in range(n) for lang in [draw.choice(sorted(words))]]


def test_held_out_accuracy(stored):
    rows = make_rows()
    got = {r.doc_id: r for r in language_id.identify(stored(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held} and held
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_never_used(stored):
    rows = make_rows()
    blind = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(stored(x, "doc_id bigint, text string, lang string")).collect()) for x in (rows, blind))
    assert a == b


def test_against_plain_naive_bayes():
    import numpy as np

    texts = ["the cat", "der hund", "x", "", "é É", "a" * 5000]
    matrix = np.random.default_rng(0).integers(-900_000, -1, (language_id.BUCKETS, 3)).astype(np.int32)
    model = language_id.Model(("a", "b", "c"), np.array([1, 2, 3]), matrix)
    langs, scores = model.predict(texts)
    for t, lang, s in zip(texts, langs, scores):
        grams, _ = language_id.gram_buckets([t])
        total = matrix[grams].astype(np.int64).sum(axis=0) + model.priors
        p = np.exp(total / language_id.SCALE - (total / language_id.SCALE).max())
        assert lang == ("abc"[int(total.argmax())] if len(grams) else "und")
        assert abs(s - (p.max() / p.sum() if len(grams) else 0)) < 1e-9


def test_batches_do_not_matter():
    g, off = language_id.gram_buckets(["ab c", "", "ab c"])
    one, _ = language_id.gram_buckets(["ab c"])
    assert g[off[0] : off[1]].tolist() == g[off[2] : off[3]].tolist() == one.tolist()


def test_odd_and_empty(odd, empty, odd_rows):
    got = language_id.identify(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_nothing_learned(stored):
    got = language_id.identify(stored([(1, "abc", None)], "doc_id bigint, text string, lang string")).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_fit_against_plain_counts(stored):
    import numpy as np

    rows = [*make_rows(60), (900, None, "en"), (901, "", "de"), (902, "12 ..", "es"), (903, "no label", None), (None, "Nur Wörter", "de"), (None, "Nur Wörter", "de")]
    model = language_id.fit(stored(rows, "doc_id bigint, text string, lang string"))
    langs = sorted({r[2] for r in rows if r[2]})
    counts, docs = {x: np.zeros(language_id.BUCKETS) for x in langs}, dict.fromkeys(langs, 0)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] += 1
            for b in language_id.gram_buckets([text])[0]:
                counts[lang][b] += 1
    assert model.langs == tuple(langs)
    for k, x in enumerate(langs):
        want = np.log((counts[x] + 0.5) / (counts[x] + 0.5).sum()) * language_id.SCALE
        assert abs(model.matrix[:, k] - want).max() <= 0.51
        assert abs(model.priors[k] - np.log(docs[x] / sum(docs.values())) * language_id.SCALE) <= 0.51


def test_sample_of_rows_without_ids(stored):
    """Beyond the sample, rows with null or one repeated id are drawn by their texts: no language is lost, nor taken whole."""
    draw = random.Random(3)
    texts = {"en": ["the", "of", "tion", "and"], "de": ["der", "und", "ich", "keit"]}
    rows = [(None, " ".join(draw.choice(texts[lang]) for _ in range(12)), lang) for lang in texts for _ in range(12_500)]
    table = stored(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(table, sample=100)
    assert model.langs == ("de", "en")
    found = language_id.predict(table, model, ("lang",)).where("doc.lang = lang_pred").count()
    assert found >= 0.99 * len(rows)
    few = language_id.fit(stored([(5, "the cat of", "en")] * 500 + [(6, "der hund", "de")] * 400, "doc_id bigint, text string, lang string"), sample=1)
    assert few.predict(["the cat of", "der hund"])[0] == ["en", "de"]


def test_sample_is_bounded(stored, monkeypatch):
    seen = []
    rows = [(None if i % 2 else 7, f"word{i} and others", "en") for i in range(5_000)]
    kept = language_id.map_arrow
    monkeypatch.setattr(language_id, "map_arrow", lambda df, f, schema: seen.append(df.count()) or kept(df, f, schema))
    language_id.fit(stored(rows, "doc_id bigint, text string, lang string"), sample=200)
    assert len(seen) == 1 and 100 < seen[0] < 320
