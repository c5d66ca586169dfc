"""The jobs: growing input, reruns, batches that run again, config files, and their SQL twins."""

import logging
import os
import random
import subprocess
import sys
import unicodedata

import duckdb
import pytest

from jobs import answer_questions, ingest_sessions, registry
from jobs.settings import read_config

draw = random.Random(21)
WORDS = ["alpha", "beta", "Gamma", "delta", "straße", "日本", "x1", "…"]
TURNS = "conv_id bigint, turn bigint, role string, text string"


def turns(conversations, numbers):
    return [(c, t, ["user", "assistant", "system"][t % 3], f"{c} {t} " + " ".join(draw.choice(WORDS) for _ in range(draw.choice([0, 3, 30])))) for c in conversations for t in numbers]


def strip(text):
    return "".join(c for c in text or "" if unicodedata.category(c)[0] in "LN")


def expected(*batches):
    out = {}
    for batch in batches:
        rows = {}
        for c, t, role, text in batch:
            if c is not None and t is not None and role in ("user", "assistant") and strip(text):
                rows[c, t] = min(rows.get((c, t), (role, text.strip())), (role, text.strip()))
        out = rows | out
    return sorted((str(c), t, role + "/message", text, strip(text)) for (c, t), (role, text) in out.items())


def check_sessions(spark, output):
    """Sessions are what their messages say."""
    per = {}
    for r in ingest_sessions.read_messages(spark, output).collect():
        per.setdefault((r.session_id, r.workspace, r.month), []).append(r)
    want = set()
    for (session, place, month), rows in per.items():
        users = [r for r in rows if r.type == "user/message"]
        title = " ".join(min(users, key=lambda r: r.seq).text.split())[:80].rstrip() if users else ""
        want.add((session, place, title, len(rows), max(r.seq for r in rows), min(r.time for r in rows), max(r.time for r in rows), month))
    got = [tuple(r) for r in ingest_sessions.read_sessions(spark, output).collect()]
    assert len(got) == len(want) and set(got) == want


def stored(spark, output):
    check_sessions(spark, output)
    return sorted((r.session_id, r.seq, r.type, r.text, r.norm) for r in ingest_sessions.read_messages(spark, output).collect())


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / name) for name in ("logs", "messages", "checkpoint")]


def add(spark, rows, folder):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)


def test_growing_input(spark, folders, caplog):
    first = [*turns(range(40), range(6)), (None, 1, "user", "no session"), (3, None, "user", "no number"), (4, 0, "user", None), (5, 90, "user", "…")]
    again = [(0, 0, "user", "another text of an old message"), *turns(range(20), range(4, 12)), *turns(range(60, 65), range(3)), *turns([60], [0])]
    add(spark, first, folders[0])
    with caplog.at_level(logging.INFO):
        assert ingest_sessions.run(spark, *folders) == {"batches": 1, "turns": len(first), "messages": len(expected(first))}
        assert stored(spark, folders[1]) == expected(first)
        add(spark, again, folders[0])
        done = ingest_sessions.run(spark, *folders)
    assert done == {"batches": 1, "turns": len(again), "messages": len(expected(first, again)) - len(expected(first))}
    assert stored(spark, folders[1]) == expected(first, again)
    assert ingest_sessions.run(spark, *folders) == {"batches": 0, "turns": 0, "messages": 0}
    assert stored(spark, folders[1]) == expected(first, again)
    assert f"read {len(again)} turns of {folders[0]} in 1 batches" in caplog.text


def test_a_batch_that_runs_again(spark, folders):
    """A run that died after it wrote and before it was marked as done: the batch comes again and overwrites itself."""
    parts = [turns(range(9), range(4)), turns(range(5, 14), range(2, 7))]
    for part in parts:
        add(spark, part, folders[0])
        ingest_sessions.run(spark, *folders)
    want = stored(spark, folders[1])
    os.remove(f"{folders[2]}/commits/1")
    for name in os.listdir(f"{folders[2]}/commits"):
        if name.startswith(".1."):
            os.remove(f"{folders[2]}/commits/{name}")
    assert ingest_sessions.run(spark, *folders)["batches"] == 1
    assert stored(spark, folders[1]) == want == expected(*parts)


@pytest.mark.parametrize("step", ["messages", "sessions"])
def test_a_run_that_dies_inside_a_batch(spark, folders, monkeypatch, step):
    """Whichever of the two tables was written last, the next run ends up with the same rows."""
    parts = [turns(range(9), range(4)), turns(range(5, 14), range(2, 7))]
    add(spark, parts[0], folders[0])
    ingest_sessions.run(spark, *folders)
    add(spark, parts[1], folders[0])
    kept = ingest_sessions._write

    def write(rows, path, *by):
        if path.endswith(step):
            raise InterruptedError(path)
        kept(rows, path, *by)

    with monkeypatch.context() as m:
        m.setattr(ingest_sessions, "_write", write)
        with pytest.raises(Exception, match="InterruptedError"):
            ingest_sessions.run(spark, *folders)
    assert ingest_sessions.run(spark, *folders)["batches"] == 1
    assert stored(spark, folders[1]) == expected(*parts)


def test_batches_of_few_files(spark, folders):
    parts = [turns(range(k, k + 6), range(5)) for k in range(0, 12, 3)]
    for part in parts:
        add(spark, part, folders[0])
    done = ingest_sessions.run(spark, *folders, {"files_per_batch": 1})
    assert done["batches"] == 4 and done["messages"] == len(stored(spark, folders[1]))
    assert [r[:2] for r in stored(spark, folders[1])] == sorted({(str(c), t) for p in parts for c, t, role, text in p if role != "system"})


def test_no_input_yet(spark, folders):
    os.makedirs(folders[0])
    assert ingest_sessions.run(spark, *folders)["batches"] == 0
    assert stored(spark, folders[1]) == []


def test_partitions_are_read_by_month(spark, folders):
    add(spark, turns(range(0, 100, 10), range(3)), folders[0])
    ingest_sessions.run(spark, *folders)
    months = {r.month for r in ingest_sessions.read_messages(spark, folders[1]).select("month").distinct().collect()}
    assert len(months) > 2
    one = ingest_sessions.read_messages(spark, folders[1]).where(f"month = '{min(months)}'")
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString() and 0 < one.count() < len(stored(spark, folders[1]))


def test_answers(spark, tmp_path):
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"topic{c % 4} " + " ".join(draw.choice(WORDS) for _ in range(12)) + (" the needle in question" if (c, t) in {(3, 1), (3, 2), (3, 30), (5, 0)} else "")) for c in range(8) for t in range(40)]
    spark.createDataFrame(talk, TURNS).repartition(5).write.parquet(str(tmp_path / "turns"))
    asked = [(1, "the needle in question"), (2, "qqqq zzzz"), (3, None), (4, "x")]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(str(tmp_path / "asked"))
    out = str(tmp_path / "answers")
    for _ in range(2):
        done = answer_questions.run(spark, str(tmp_path / "turns"), str(tmp_path / "asked"), out, {"hits": 4})
        assert done == {"turns": 320, "questions": 4, "answered": 1, "rows": 3}
        got = sorted((r.item_id, r.place, r.session_id, r.workspace, r.episode, r.start_seq, r.end_seq, r.hit_count) for r in answer_questions.read_answers(spark, out).collect())
        told = {(r.session_id, r.best_seq, r.answer) for r in answer_questions.read_answers(spark, out).collect()}
        assert told == {(str(c), t, x[:240]) for c, t, _, x in talk if (c, t) in {(3, 1), (5, 0)}}
        assert got == [(1, 1, "3", "/ws/3", 1, 1, 2, 2), (1, 1, "3", "/ws/3", 2, 30, 30, 1), (1, 2, "5", "/ws/1", 1, 0, 0, 1)]


def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"files_per_batch": 3}')
    assert read_config(spark, str(path), ingest_sessions.DEFAULTS) == ingest_sessions.DEFAULTS | {"files_per_batch": 3}
    for wrong in ('{"other": 1}', '{"files_per_batch": "many"}'):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            read_config(spark, str(path), ingest_sessions.DEFAULTS)
    for job in (ingest_sessions, answer_questions):
        assert read_config(spark, job.__file__.replace(".py", ".json"), job.DEFAULTS).keys() == job.DEFAULTS.keys()


def test_command_lines(spark, tmp_path):
    talk = turns(range(4), range(5))
    add(spark, talk, str(tmp_path / "turns"))
    asked = max((x for x in talk if x[2] == "user"), key=lambda x: len(x[3]))
    spark.createDataFrame([(1, asked[3])], "item_id bigint, text string").write.parquet(str(tmp_path / "asked"))
    root, paths = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), {k: str(tmp_path / k) for k in ("turns", "asked", "messages", "checkpoint", "answers")}
    for job, given in (("ingest_sessions", {"source": "turns", "output": "messages", "checkpoint": "checkpoint"}), ("answer_questions", {"conversations": "turns", "questions": "asked", "output": "answers"})):
        line = [sys.executable, "-m", f"jobs.{job}", "--config", f"jobs/{job}.json", *(x for k, v in given.items() for x in (f"--{k}", paths[v]))]
        done = subprocess.run(line, cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and f" {job} read 20 turns of {paths['turns']}" in done.stderr, done.stderr[-2000:]
    assert stored(spark, paths["messages"]) == expected(talk)
    assert answer_questions.read_answers(spark, paths["answers"]).where("item_id = 1 and place = 1").first().session_id == str(asked[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL_BY_NAME[name]).to_arrow_table()
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toArrow()
    rows = lambda t: sorted(tuple(str(r[k]) for k in sorted(r)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want) and got.num_rows > 0
