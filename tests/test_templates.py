import datetime as dt

import pytest
from pyspark.sql import functions as F

from cordwood.operators import templates as T

SCHEMA = "source string, line_number long, byte_offset long, text string, read_at timestamp, level int"
AT = dt.datetime(2024, 9, 12, 12, 0)


def found(spark, texts, source="a.log"):
    rows = [(source, i + 1, 0, t, AT, 1) for i, t in enumerate(texts)]
    out = T.found(spark.createDataFrame(rows, SCHEMA)).orderBy("source", "line_number").collect()
    return [(r.line_number, r.n_lines, r.utc_us and dt.datetime.fromtimestamp(r.utc_us / 1e6, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"), r.level, r.component, r.msg_chars, r.exc_type) for r in out]


def test_layouts(spark):
    texts = [
        "2024-09-12 11:52:27,477 - tarn.replicator - INFO - Merged 93 rows",
        "2024-09-12 11:52:28,477 [pool-1-thread-8] WARN  org.tarn.Intake - Slow query\r",
        "2024-09-12 11:52:29.106 [ERROR] SearchNode: Finished - done",
        "TRACE | 2024-09-12T16:17:05.905+02:00 | orderdesk | Queue grew",
        "I0912 19:13:56.577837  14670 ledger.cc:174] Timed out",
        "[14:20:41 DBG] <Tarn.OrderDesk.Intake> Finished order sweep",
        "<37>Sep 12 13:46:56 box38 audittrail[6610]: Accepted",
        '<84>1 2024-09-12T06:44:35.331Z box3 orderdesk 5598 REQ [o@41 note="a \\] b"] Peer dropped',
        '{"@t":"2024-09-12T14:26:16.420334Z","@mt":"Slow {A} and {B}","A":"x","B":12,"SourceContext":"Tarn.Feed"}',
        '{"pid":1,"component":"Tarn.Desk","severity":"warn","timestamp":1726142076641,"message":"Queue"}',
        '{"Timestamp":"2024-09-12T14:00:00.000+02:00","Level":"Fatal","MessageTemplate":"a {B}","Properties":{"B":"c","SourceContext":"X"}}',
        'ts=1726791460040 level=error component=throttle msg="Opened \\"x\\""',
    ]
    assert [x[2:6] for x in found(spark, texts)] == [
        ("2024-09-12 11:52:27.477000", "Information", "tarn.replicator", 14), ("2024-09-12 11:52:28.477000", "Warning", "org.tarn.Intake", 10),
        ("2024-09-12 11:52:29.106000", "Error", "SearchNode", 15), ("2024-09-12 14:17:05.905000", "Verbose", "orderdesk", 10),
        ("2024-09-12 19:13:56.577837", "Information", "ledger.cc", 9), ("2024-09-12 14:20:41.000000", "Debug", "Tarn.OrderDesk.Intake", 20),
        ("2024-09-12 13:46:56.000000", "Information", "audittrail", 8), ("2024-09-12 06:44:35.331000", "Warning", "orderdesk", 12),
        ("2024-09-12 14:26:16.420334", "Information", "Tarn.Feed", 13), ("2024-09-12 11:54:36.641000", "Warning", "Tarn.Desk", 5),
        ("2024-09-12 12:00:00.000000", "Fatal", "X", 3), ("2024-09-20 00:17:40.040000", "Error", "throttle", 10),
    ]


HEAD = "2024-09-12 11:52:29.106 [ERROR] SearchNode: Finished"


def test_entries_and_traces(spark):
    texts = [
        "text above any entry", HEAD, "System.IO.IOException: boom", " ---> System.TimeoutException: inner", "   at A.B(Int32 id) in C:\\a.cs:line 8", "java.lang.X: later", "\tat b.c.d(E.java:1)", "", "  ",
        HEAD, "Traceback (most recent call last):", '  File "/a.py", line 1, in f', "    x = y[2]", "tarn.errors.BudgetError: gone", "", "{", '  "level": "low"', "}",
        HEAD, "> 2024-09-12 11:52:29.106 [ERROR] SearchNode: quoted", "    2024-09-12 11:52:29 INFO indented",
        '{"@t":"2024-09-12T14:26:16Z","@m":"x","@x":"A.FirstException: m\\n   at q"}', '{"retry":5}', "java.io.Y: x", "\tat q.w(E.java:1)",
    ]
    got = found(spark, texts)
    assert [(x[0], x[1], x[6]) for x in got] == [(2, 6, "System.IO.IOException"), (10, 9, "tarn.errors.BudgetError"), (19, 3, ""), (22, 4, "A.FirstException")]


def test_entries_run_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_LINES", 3)
    texts = [HEAD, *["more"] * 7, "a.b.CException: x", "   at q()", "x", HEAD, "  tail"]
    assert [(x[0], x[1], x[6]) for x in found(spark, texts)] == [(1, 11, "a.b.CException"), (12, 2, "")]


def test_nulls_copies_long_lines_and_empty(spark):
    rows = [("a", 1, 0, HEAD, AT, 1)] * 3 + [("a", 2, 0, None, AT, 1), ("a", 3, 0, "x" * 300_000, None, 1), (None, 1, 0, HEAD, AT, 1), ("a", None, 0, HEAD, AT, 1)]
    out = T.found(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.line_number, r.n_lines) for r in out] == [(1, 3)]
    assert T.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_iterative_partitioning():
    seq = {("STAMP", "[", "LEVEL", "]", "W", ":"): 5, ("STAMP", "[", "LEVEL", "]", "W", "W"): 2, ("W", "W"): 3, ("W", "N"): 1}
    leaves = T.partition(seq)
    assert sum(len(m) for _, m in leaves) == 4 and len({len(t) for t, _ in leaves}) == 2
    assert T.layout_of(("STAMP", "[", "LEVEL", "]", "W", ":")) and T.layout_of(("W", "N")) is None and T.layout_of((">", "STAMP", "LEVEL", "W", ":")) is None


def test_leaves_decide_layouts(spark):
    head = ("STAMP", "[", "LEVEL", "]", "W", ":")
    leaves = T.partition({(*head, "W", "N"): 5, (*head, "N", "W"): 2, (*head, "W", "W"): 1, ("W",) * 8: 3})
    assert [t for t, _ in leaves] == [(*head, None, None), ("W",) * 8]
    inside = ("STAMP", "[", None, "]", "LEVEL", "W", "-")
    slots = [{x} if x else {"N", "W"} for x in inside]
    assert T.read_head("2024-09-12 11:52:29 [7] WARN a.b - x", T.layout_of(inside, slots), None)[1:4] == ("Warning", "a.b", "x")
    assert T.read_head("2024-09-12 11:52:29 [t7] WARN a.b - x", T.layout_of(inside, slots), None)[1:4] == ("Warning", "a.b", "x")
    with pytest.raises(T.Unsettled):
        T.layout_of(("STAMP", None, "W", ":"), [{"STAMP"}, {"LEVEL", "W"}, {"W"}, {":"}])
    lines = spark.createDataFrame([("a", i, 0, f"{HEAD} {x}", AT, 1) for i, x in enumerate(("x 1", "1 x", "x y"))], SCHEMA)
    rows = T.leaf_templates(lines).collect()
    assert len(rows) == 3 and {r.template for r in rows} == {"STAMP [ LEVEL ] W : W * *"} and len({r.layout for r in rows}) == 1


def test_long_heads(spark):
    stamp = "2024-09-12 11:52:29.106"
    texts = [
        f"{stamp} [main] [req 7 of 9] [user a b c] [zone x y] WARN org.tarn.Intake - Slow query",
        f"{stamp} [ERROR] [a b c d e f g h i j k l m n o p q r s t u v w x y z] SearchNode: Finished",
        f"{stamp} [ERROR] " + "word " * 5000,
        f"{stamp} one two three four five six seven eight nine ten eleven ERROR Node: prose",
        "I0912 19:13:56.577837  14670 [a b c d] ledger.cc:174] Timed out",
    ]
    assert [(x[0], x[1], *x[3:6]) for x in found(spark, texts)] == [(1, 1, "Warning", "org.tarn.Intake", 10), (2, 3, "Error", "SearchNode", 8), (5, 1, "Information", "ledger.cc", 9)]
    assert len(T.head_classes(texts[2])) == T.HEAD_TOKENS and len(T.head_classes(texts[3])) == T.HEAD_TOKENS


def test_messages_have_templates_and_slots(spark):
    rows = [(f"job {i} {('started', 'stopped')[i % 2]} on node{i % 3}",) for i in range(40)] + [(f"cache {('hit', 'miss')[i % 2]}",) for i in range(20)] + [(None,), ("  ",), ("cache hit",)]
    got = T.message_templates(spark.createDataFrame(rows, "message string").withColumn("template", F.lit("x"))).collect()
    assert len(got) == len(rows) and {r.template for r in got if r.message is None or not r.message.strip()} == {""}
    for r in got:  # every message is its template with its slots filled in
        slots = iter(r.slots)
        assert " ".join(next(slots) if t == "*" else t for t in r.template.split()) == " ".join((r.message or "").split())
    assert {"cache hit", "cache miss"} <= {r.template for r in got} and any(r.template.startswith("job * started") for r in got)
    assert T.message_templates(spark.createDataFrame([], "message string")).count() == 0
