"""Logs of single sessions: reading those that changed, and logs that grow at their end."""

import json

import pytest

from threadloom.operators import anchors
from threadloom.sources import eventlog
from threadloom.streaming.anchors import TEXTS, start_anchor_texts


def line(session, seq, text="x"):
    return json.dumps({"session_id": session, "seq": seq, "type": "user/message", "time": seq, "data": {"content": text}}, ensure_ascii=False) + "\n"


def rows_and_files(df):
    """Rows of a query that did not run yet, and how many files its scans opened."""
    rows = sorted(map(tuple, df.collect()))
    return rows, sum(node.metrics().apply("numFiles").value() for node in scans(df._jdf.queryExecution().executedPlan()))


def scans(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        return scans(node.executedPlan())
    own = [node] if node.nodeName().startswith("Scan text") else []
    inner = [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    return own + [x for n in inner for x in scans(n)]


def test_only_changed_sessions_are_opened(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"s{n}.jsonl").write_text(line(f"s{n}", 1) + line(f"s{n}", 2))
    changed = spark.createDataFrame([("s3",), ("s17",), ("s3",), ("unknown",)], "id string")
    found, files = rows_and_files(eventlog.read_changed(spark, str(tmp_path), changed))
    assert [r[:2] for r in found] == [("s17", 1), ("s17", 2), ("s3", 1), ("s3", 2)] and files == 2
    assert rows_and_files(eventlog.read_changed(spark, str(tmp_path), changed, most=1)) == (found, 40)
    assert eventlog.read_changed(spark, str(tmp_path), changed.where("false")).count() == 0


def take(spark, folder, marks, **more):
    new, marks = eventlog.tail_log(spark, str(folder), marks, **more)
    got = sorted((r.session_id, r.seq, json.loads(r.data)["content"]) for r in new.collect())
    return got, spark.createDataFrame(marks.collect(), eventlog.MARKS)


def test_a_log_that_grows_in_the_middle_of_a_line(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    text = "".join(line("a", k, "日本語 é\\n" * k) for k in range(6)).encode()
    b.write_text(line("b", 1) + "\n")
    a.write_bytes(b"")
    got, marks = take(spark, tmp_path, None)
    assert got == [("b", 1, "x")]
    collected, at = [], 0
    for step in (7, 1, 150, 2, 33, 400, 1):  # also inside characters
        at += step
        a.write_bytes(text[:at])
        got, marks = take(spark, tmp_path, marks)
        collected += got
        assert [s for _, s, _ in collected] == list(range(text[:at].count(b"\n")))
    a.write_bytes(text)
    got, marks = take(spark, tmp_path, marks)
    assert [s for _, s, _ in collected + got] == list(range(6)) and (collected + got)[5][2] == "日本語 é\\n" * 5
    assert take(spark, tmp_path, marks)[0] == []
    a.write_text(line("a", 90))  # begun anew
    assert take(spark, tmp_path, marks)[0] == [("a", 90, "x")]


def test_results_stand_for_one_moment(spark, tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text(line("a", 1))
    new, marks = eventlog.tail_log(spark, str(tmp_path))
    log.write_text(line("a", 1) + line("a", 2))
    assert new.count() == 1 and marks.first().lines == 1
    assert [r[1] for r in take(spark, tmp_path, spark.createDataFrame(marks.collect(), eventlog.MARKS))[0]] == [2]


def test_few_files_at_a_time(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"s{n}.jsonl").write_text(line(f"s{n}", n))
    found, marks = [], None
    for _ in range(3):
        got, marks = take(spark, tmp_path, marks, most=2)
        found.append(len(got))
    assert found == [2, 2, 1] and marks.count() == 5


@pytest.mark.parametrize("per_trigger", [1, 10])
def test_streamed_anchor_texts(spark, tmp_path, per_trigger):
    rows = [(str(n), k, "user/message" if k % 2 else "assistant/message", f"text {n} {k} " + "…" * (k * n % 7)) for n in range(6) for k in range(9)]
    events = spark.createDataFrame(rows, "session_id string, seq bigint, type string, text string")
    parts = [[(str(n), 4, 0, 3, f"first {n}") for n in range(4)], [(str(n), 9, 4, 8, None) for n in range(6)], [("none", 1, 0, 0, " ")]]
    schema, folder = "session_id string, at bigint, low bigint, high bigint, summary string", str(tmp_path / "texts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "summaries"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "summaries"))
        start_anchor_texts(stream, lambda: events, folder, str(tmp_path / "checkpoint")).awaitTermination()
    want = anchors.anchor_texts(spark.createDataFrame([r for p in parts for r in p], schema), events)
    got = spark.read.schema(TEXTS).parquet(folder).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 11
