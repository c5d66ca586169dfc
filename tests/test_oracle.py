"""Every query with an SQL twin gives the same rows in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from threadloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "conversations documents embeddings benchmark labels events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(table):
    def text(v):
        if v is None:
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, (int, bool)) else str(v)

    return sorted(tuple(text(r[k]) for k in sorted(r)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL_BY_NAME))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toArrow(), duck.execute(registry.ORACLE_SQL_BY_NAME[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rowid", "session_id", "seq", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL_BY_NAME)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
