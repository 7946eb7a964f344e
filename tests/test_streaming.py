import datetime as dt
import time

import pytest

from cordwood.operators.highlight import Rule
from cordwood.sources import tail
from cordwood.streaming import pipeline


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_tail_stream(spark, tmp_path):
    tail.register(spark)
    path = tmp_path / "live.log"
    path.write_text("2026-01-01 00:00:01 INFO a\n2026-01-01 00:00:02 ERROR b\n")
    rows = drain(spark, pipeline.prepared(spark.readStream.format("cordwood_tail").option("path", str(path)).load()), "tailed", tmp_path)
    assert [(r.line_number, r.severity, r.shape) for r in rows] == [(1, 2, "<datetime> INFO a"), (2, 4, "<datetime> ERROR b")]


@pytest.fixture
def batches(spark, tmp_path):
    def write(rows, schema, *parts):
        folder = tmp_path / "in"
        for i, part in enumerate(parts or [rows]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return write


def test_novelty_and_alerts(spark, batches, tmp_path):
    schema = "source string, epoch int, line_number long, text string"
    texts = ["ERROR a 1", "INFO z", "ERROR b", "ERROR a 2", "ERROR c", "ERROR c"]
    stream = batches([("s", 0, i + 1, t) for i, t in enumerate(texts)], schema)
    rows = drain(spark, pipeline.novelty(pipeline.prepared(stream), 2).select("line_number"), "novel", tmp_path)
    assert sorted(r.line_number for r in rows) == [3, 5]


def test_novelty_counts_what_it_saw(spark, batches, tmp_path):
    schema = "source string, epoch int, line_number long, text string"
    stream = batches(None, schema, [("s", 0, 900_000, "ERROR a"), ("s", 0, 900_001, "quiet")], [("s", 0, 900_002, "ERROR b"), ("s", 1, 1, "ERROR b")])
    rows = drain(spark, pipeline.novelty(pipeline.prepared(stream), 2), "novel_late", tmp_path)
    assert [(r.epoch, r.line_number) for r in rows] == [(0, 900_002)]


def test_sessions(spark, batches, tmp_path):
    at = lambda s: None if s is None else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    schema = "source string, thread string, line_number long, ts timestamp"
    stream = batches(None, schema, [("s", "1", 1, at(0)), ("s", None, 2, at(0)), ("s", "1", 3, at(1))], [("s", "1", 4, None), ("s", "1", 5, at(60)), ("s", "1", 6, at(90)), ("s", "1", 7, at(91))])
    rows = {r.line_number: r.block_id for r in drain(spark, pipeline.sessions(stream, most=2), "sessions", tmp_path)}
    assert rows == {1: "s\x1f1\x1f1\x1f0", 2: "s\x1f\0\x1f2\x1f0", 3: "s\x1f1\x1f1\x1f0", 4: "s\x1f1\x1f1\x1f1", 5: "s\x1f1\x1f1\x1f1", 6: "s\x1f1\x1f6\x1f0", 7: "s\x1f1\x1f6\x1f0"}


def test_volume_from_the_first_time_loses_nothing(spark, batches, tmp_path):
    stream = batches(None, "source string, text string", [("s", "2026-01-01 00:00:03 ERROR a")], [("s", "2026-01-01 01:00:00 c")], [("s", "2026-01-01 00:00:12 late")])
    counts = pipeline.volume(pipeline.prepared(stream), "10 seconds", first=dt.datetime(2026, 1, 1, 0, 0, 3, tzinfo=dt.timezone.utc))
    q = counts.writeStream.format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "bins")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.minute, r.start.second, r.total) for r in spark.table("bins").collect())[0][2] == 2


def test_alert_stream(spark, batches, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    schema = "rule_id string, ts timestamp, line_number long"
    stream = batches(None, schema, [("r", at(0), 0), ("r", at(1), 1)], [("r", at(2), 2), ("r", at(3), 3), ("q", at(3), 9)])
    rows = drain(spark, pipeline.alerts(stream, [Rule("r", "x", threshold=3, window_us=60_000_000)]), "alerted", tmp_path)
    assert [(r.rule_id, r.line_number) for r in rows] == [("r", 2)]


def test_reorder():
    order = pipeline.Reorder(2.0)
    order.add("a", 1, "a1", 0.0)
    order.add("b", 3, "b3", 0.5)
    order.add("a", None, "more", 0.6)
    assert order.due(1.0) == []
    order = pipeline.Reorder(2.0, order.kept())
    order.add("b", 2, "b2", 1.9)
    assert order.due(2.0) == [(1, "a", "a1"), (2, "a", "more"), (3, "b", "b2"), (4, "b", "b3")]
    order.add("a", 0, "late", 5.0)
    assert order.due(5.0, True) == [(5, "a", "late")]


def test_merged_stream(spark, batches, tmp_path):
    schema = "grp string, source string, text string"
    stream = batches([("g", "a", "2026-01-01 00:00:03 x"), ("g", "b", "2026-01-01 00:00:02 y")], schema)
    # a query with processing-time timers never runs out of batches, so it is stopped once its rows are there
    q = pipeline.merged(stream, "grp", 0.0).writeStream.format("memory").queryName("merged_view").option("checkpointLocation", str(tmp_path / "m")).outputMode("append").start()
    until = time.time() + 30
    while time.time() < until and spark.table("merged_view").count() < 2:
        time.sleep(0.3)
    q.stop()
    rows = spark.table("merged_view").collect()
    assert [(r.line_number, r.text) for r in rows] == [(1, "b│ 2026-01-01 00:00:02 y"), (2, "a│ 2026-01-01 00:00:03 x")]


def test_volume_stream(spark, batches, tmp_path):
    schema = "source string, text string"
    stream = batches(None, schema, [("s", "2026-01-01 00:00:01 ERROR a"), ("s", "2026-01-01 00:00:02 WARN b")], [("s", "2026-01-01 01:00:00 c")])
    rows = drain(spark, pipeline.volume(pipeline.prepared(stream), "10 seconds", "1 second"), "volumes", tmp_path)
    assert [(r.total, r.warnings, r.errors) for r in rows] == [(2, 1, 1)]


def test_last_lines(spark, tmp_path):
    sink = pipeline.last_lines(str(tmp_path / "ring"), 2)
    for epoch, part in enumerate([[1, 2, 3], [4]]):
        sink(spark.createDataFrame([("s", n, "t") for n in part], "source string, line_number long, text string"), epoch)
    assert sorted(r.line_number for r in spark.read.parquet(str(tmp_path / "ring" / "1")).collect()) == [3, 4]
