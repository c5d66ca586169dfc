"""Tables that operators must survive: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, size bigint, sid string, n int, lang_pred string, score double, __text string, `a.b` int, doc string, key string, copies int"


@pytest.fixture(scope="session")
def odd_rows():
    long = "alpha beta gamma delta epsilon zeta " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, "  \n\t ", "de", "b"),
        (6, "…!?—", None, "b"),
        (7, long, "en", "a"),
        (8, long + "end", "en", None),
        (None, "no id here at all but a few words", "en", "a"),
        (None, None, None, None),
        (9, "tie", "en", "b"),
        (9, "tie", "en", "b"),
        (9, "other text with the same id", "en", "b"),
        (10, "ÄÖÜ straße naïve café 漢字 \U0001f600 text", "de", "ä"),
        (11, "\x00 control \x1f chars ퟿", "fr", "a"),
    ]
    return [r + (None, 1, 2, "x", 3, "zz", 9.0, "other", 4, "d", "k", 5) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A function that writes (doc_id, text) rows and reads them back."""

    def make(rows, schema="doc_id bigint, text string", parts=3):
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
