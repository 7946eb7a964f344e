import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cordwood.operators import annotations, blocks, exceptions, grid, highlight, patterns, search, traces, volume

UTC = dt.timezone.utc
EVENTS = "source string, line_number long, ts timestamp, ts_offset_min int, level string, message_template string, message string, exception string, properties map<string,string>, trace_id string, span_id string"


def events(spark, rows):
    """rows: (line, seconds or None, level, template, message, properties[, exception[, trace, span]])."""
    made = []
    for r in rows:
        n, s, level, template, message, props, *more = r
        at = None if s is None else dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=s)
        exc, trace, span = [*more, None, None, None][:3]
        made.append(("s", n, at, 0, level, template, message, exc, props, trace, span))
    return spark.createDataFrame(made, EVENTS)


def lines(spark, texts, source="s"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source string, line_number long, text string")


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# ---- search -----------------------------------------------------------------------------------------------------


def test_search(spark):
    ls = lines(spark, ["Alpha error", "ÉTÉ Error", None, "beta", '{"@m":"hello","User":"Bob"}'])
    assert values(search.search(ls, "ERROR"), "line_number") == [(1,), (2,)]
    assert values(search.search(ls, "Error", case=True), "line_number") == [(2,)]
    assert values(search.search(ls, "^été", regex=True), "line_number") == [(2,)]
    assert search.search(ls, "").count() == 0
    assert values(search.search(ls, "bob", prop="User"), "line_number") == [(5,)] and values(search.search(ls, "hello", prop="@Message"), "line_number") == [(5,)]
    with pytest.raises(ValueError):
        search.line_matcher("(", True)
    with pytest.raises(ValueError):
        search.line_matcher("")
    m = search.line_matcher("error")
    assert [search.find_next(ls, n, f, m, w).first()[0] for n, f, w in ((1, True, True), (2, True, True), (2, True, False), (1, False, True), (2, False, True))] == [2, 1, None, 2, 1]
    assert search.count_matches(ls, m).first()[0] == 2


def test_times(spark):
    rows = search.with_delta(search.with_effective_ts(lines(spark, ["none", "2026-01-01 00:00:01 a", "more", "2026-01-01 00:00:03 b"]))).orderBy("line_number").collect()
    assert [r.effective_ts and r.effective_ts.second for r in rows] == [None, 1, 1, 3] and [r.delta_us for r in rows] == [None, None, None, 2_000_000]
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s, tzinfo=UTC)
    ls = lines(spark, ["x", "2026-01-01 00:00:01", "y", "2026-01-01 00:00:05", "2026-01-01 00:00:09", "z"])
    assert [r.line_number for r in search.time_range(ls, at(1), at(5)).orderBy("line_number").collect()] == [2, 3, 4]
    assert [r.line_number for r in search.time_range(ls, None, at(1)).orderBy("line_number").collect()] == [1, 2, 3]
    assert [r.line_number for r in search.time_range(ls, at(4), None, 2).collect()] == [4, 5]
    assert search.latest_ts(ls, 2).first().ts.second == 9 and search.latest_ts(ls.where("line_number <> 5"), 2).count() in (0, 1)


def test_filter_view(spark):
    rows = search.with_effective_ts(events(spark, [(1, 0, "Error", None, "a 1", {"K": "v"}), (2, 5, "info", None, "b 2", {}), (3, None, None, None, "an ERROR c", {}), (4, 9, "Debug", None, "a 3", {"K": "v"})]), F.col("ts")).withColumn("text", F.col("message"))
    got = lambda **k: [r.line_number for r in search.apply_filters(rows, search.FilterView(**k)).orderBy("line_number").collect()]
    assert got() == [1, 2, 3, 4] and got(text="^a ") == [1, 4] and got(text="^a ", exclude=True) == [2, 3] and got(text="(") == [1, 2, 3, 4] and got(text="(", exclude=True) == [1, 2, 3, 4]
    assert got(min_level="Error") == [1, 3] and got(field="K", value="v", hide_before=2) == [4] and got(time_from="2026-01-01 00:00:05", time_to="2026-01-01 00:00:08") == [2, 3]
    ref = dt.datetime(2026, 1, 1, 0, 0, 9, tzinfo=UTC)
    assert got(time_from="-4s", reference=ref) == [2, 3, 4] and got(correlation="AN") == [3]


def test_event_log_and_paging(spark):
    rows = spark.createDataFrame([("c", i, "m1" if i % 2 else "m2", "P" if i < 4 else "Q", "Error" if i == 5 else "Info", f"t{i}") for i in range(1, 7)], "source string, record_id long, message string, provider string, level string, text string")
    rules = [search.EventRule("M1", provider="p"), search.EventRule("error", "Level"), search.EventRule("(")]
    assert sorted(values(rows.where(search.event_log_filter(rules)), "record_id")) == [(1,), (3,), (5,)]
    assert rows.where(search.event_log_filter([search.EventRule("x", enabled=False)])).count() == 6
    assert values(search.search_event_log(rows, rules, "t5"), "record_id", "line_number") == [(5, 3)]
    ls = lines(spark, list("abcde"))
    page = lambda c, n: [r.line_number for r in search.new_lines_since(ls, c, n).collect()]
    assert page(0, 2) == [1, 2] and page(-1, 2) == [4, 5] and page(99, 2) == [1, 2] and page(3, 9) == [4, 5]
    first, more = search.cap(ls, 3, "line_number")
    assert first.count() == 3 and more and search.clamp_rows(0) == 1 and search.clamp_rows(10**6) == 200


# ---- patterns and volume ----------------------------------------------------------------------------------------


def test_patterns(spark):
    e = events(spark, [(1, None, "Error", "t {A}", "t 1", {"SourceContext": "X"}), (2, 2, "Error", "t {A}", "t 2", {"SourceContext": "X"}), (3, 3, "Info", None, "n 5", {}), (4, 4, "Error", None, "boom", {"SourceContext": " "}, "E: x\n   at A.B()"), (5, 5, None, None, "n 6", {})])
    top = patterns.top_patterns(e).collect()
    assert [(r["signature"], r["count"], r.first_line, r.last_line) for r in top] == [("Error\x1ft {A}", 2, 1, 2), ("Info\x1fn <num>\x1f", 1, 3, 3), ("Error\x1fboom\x1fSourceContext", 1, 4, 4), ("\x1fn <num>\x1f", 1, 5, 5)]
    assert top[0].first_ts is None and top[0].last_ts is not None and top[0].sample_message == "t 1"
    assert [r.sample_lines for r in patterns.sample_lines(patterns.with_signature(e), patterns.top_patterns(e, None, 1)).collect()] == [[1, 2]]
    assert values(patterns.top_patterns(e, "Warning"), "count") == [(2,), (1,)]
    assert values(patterns.top_error_sources(e), "value", "count", "signatures") == [("X", 2, 1), ("A.B", 1, 1)]
    assert values(patterns.property_usage(e), "name", "events") == [("SourceContext", 3)] and values(patterns.list_properties(e, 2), "name") == [("SourceContext",)]
    assert values(patterns.level_counts(e), "errors", "warnings", "total") == [(3, 0, 5)]
    assert values(patterns.pattern_occurrences(e, "Error\x1ft {A}", 1), "line_number") == [(1,)]
    empty = events(spark, []).limit(0)
    assert patterns.top_patterns(empty).count() == 0 and patterns.top_values(empty, "A").count() == 0


def samples(spark, rows):
    base = dt.datetime(2026, 1, 1, tzinfo=UTC)
    return spark.createDataFrame([(base + dt.timedelta(seconds=s), v, i) for i, (s, v) in enumerate(rows, 1)], "ts timestamp, severity int, line_number long")


def test_volume_bins(spark):
    df = samples(spark, [(0, 2), (0, 4), (0, 3), (1, 2), (3, 5), (3, 2)])
    got = [(r.total, r.warnings, r.errors, r.first_line, r.last_line) for r in volume.volume_bins(df, 1_000_000).orderBy("bin").collect()]
    assert got == [(3, 1, 1, 1, 3), (1, 0, 0, 4, 4), (0, 0, 0, -1, -1), (2, 0, 1, 5, 6)]
    assert volume.volume_bins(df.limit(1)).count() == 0 and volume.volume_bins(df.limit(0)).count() == 0
    assert volume.volume_bins(df, 1_000, 10).count() <= 11
    assert volume.choose_bucket(120_000_000) == 1_000_000 and volume.choose_bucket(10**15) == 2_592_000_000_000


def test_volume_spikes(spark):
    bins = spark.createDataFrame([(i, 200 if i == 12 else 20 + i % 3, 12 if i == 15 else i % 2) for i in range(20)], "bin long, total long, errors long")
    rows = volume.volume_spikes(bins).collect()
    assert [r.bin for r in rows if r.is_volume_spike] == [12] and [r.bin for r in rows if r.is_error_spike] == [15]


def test_new_patterns(spark):
    rows = [(1, "a 1", 4), (2, "b", 4), (3, "c", 2), (4, "a 2", 4), (5, "d", 4), (6, "low", 1), (7, "d", 4), (8, "e 5", 3), (9, "x", None)]
    df = spark.createDataFrame([("s", *r) for r in rows], "source string, line_number long, message string, severity int")
    assert sorted(values(volume.new_patterns(df, 3), "line_number")) == [(5,), (8,)]
    rows = [(1, "quiet", None), (2, "quiet", None), (2, "quiet", None), (3, "x", 4), (4, "y", 4)]  # lines without severity warm up too, copies once
    df = spark.createDataFrame([("s", *r) for r in rows], "source string, line_number long, message string, severity int")
    assert values(volume.new_patterns(df, 2), "line_number") == [(3,), (4,)]


# ---- exceptions and entries -------------------------------------------------------------------------------------

TRACES = [
    "INFO start", "System.InvalidOperationException: Order 17 not found", "   at Shop.Load(Int32 id) in C:\\src\\Orders.cs:line 42", "ERROR in OrderException: Order 18 lost", "   at X.Y()",
    "System.InvalidOperationException: Order 99 not found", "   at Shop.Load(Int32 id) in C:\\src\\Orders.cs:line 57", "retrying after TimeoutException: will try again", "java.lang.IllegalStateException: boom", "\tat a.b.C.d(C.java:5)", "Caused by: java.io.IOException: x",
    "\tat e.f(G.java:9)", "\t... 2 more", "Traceback (most recent call last):", '  File "main.py", line 3, in <module>', "    go()", '  File "worker.py", line 9, in run', "ValueError: bad value 42", "done",
]


def test_exception_groups(spark):
    found = exceptions.occurrences(lines(spark, TRACES))
    got = {r.type: r for r in exceptions.groups(found).collect()}
    assert {k: (r["count"], r.first_line, r.last_line) for k, r in got.items()} == {
        "System.InvalidOperationException": (2, 2, 6), "OrderException": (1, 4, 4), "java.lang.IllegalStateException": (1, 9, 9), "ValueError": (1, 14, 14)}
    assert got["System.InvalidOperationException"].message == "Order 17 not found" and "Caused by" in got["java.lang.IllegalStateException"].sample and got["ValueError"].top_frame == "worker.py in run"
    assert [r.type for r in exceptions.groups(found, 2).collect()] == ["System.InvalidOperationException", "ValueError"]
    structured = events(spark, [(1, 1, "Error", None, "m", {}, "A.BException: q 12\n   at C.D() in x:line 3"), (2, None, "Error", None, "m", {}, "odd text"), (3, 2, "Error", None, "m", {}, "")])
    rows = {r.line_number: r for r in exceptions.occurrences(lines(spark, ["", "", ""]), structured).collect()}
    assert rows[1].signature == "A.BException|C.D()" and rows[2].type == "odd text" and set(rows) == {1, 2}
    assert exceptions.occurrences(lines(spark, []).limit(0)).count() == 0


def test_state_machines_do_not_depend_on_parts(spark, monkeypatch):
    random.seed(5)
    pool = [*TRACES, "", "  indented", None]
    texts = [random.choice(pool) for _ in range(400)]
    ls = lines(spark, texts)
    from cordwood.functions import ordered

    whole = (set(map(tuple, exceptions.occurrences(ls).select("line_number", "signature").collect())), set(map(tuple, exceptions.group_entries(ls).select("line_number", "head_line").collect())))
    rows = [(i + 1, None, t, None) for i, t in enumerate(texts)]
    held = [(i + 1, t, r.c) for i, (t, r) in enumerate(zip(texts, ls.orderBy("line_number").select(exceptions.line_class(F.col("text")).alias("c")).collect()))]
    assert whole[0] == {(r[0], r[4]) for r in exceptions.read(rows, "".join(c for _, _, c in held))}
    assert whole[1] == set(zip(range(1, 401), exceptions.heads([(n, c, False) for n, _, c in held])))
    monkeypatch.setattr(exceptions, "safe_groups", lambda df, key, order, safe: ordered.safe_groups(df, key, order, safe, size=7))
    assert (set(map(tuple, exceptions.occurrences(ls).select("line_number", "signature").collect())), set(map(tuple, exceptions.group_entries(ls).select("line_number", "head_line").collect()))) == whole


def test_entries(spark):
    texts = ["ERROR Payment failed", "System.TimeoutException: late", "   at A.B()", " ---> X", "--- End of inner", "INFO next", "", "   at lost()", "Traceback (most recent call last):", '  File "a.py", line 1, in f', "    x", "ValueError: z", "INFO end"]
    got = [r.head_line for r in exceptions.group_entries(lines(spark, texts)).orderBy("line_number").collect()]
    assert got == [None, 1, 1, 1, 1, None, None, None, 8, 8, 8, 8, None] or got == [None, 1, 1, 1, 1, None, None, None, None, 9, 9, 9, None]


# ---- blocks -----------------------------------------------------------------------------------------------------


def sequential(rows, gap, most):
    """Blocks of (line, seconds, thread) rows by the rule read one by one."""
    last, now, out = {}, {}, {}
    for n, s, t in rows:
        if t not in now or (last[t] is not None and s is not None and abs(s - last[t]) > gap) or len(now[t]) >= most:
            now[t] = []
            out[(t, n)] = now[t]
        now[t].append(n)
        last[t] = s
    return {tuple(v) for v in out.values()}


def test_blocks_by_proximity(spark):
    random.seed(3)
    rows, s = [], 0.0
    for n in range(1, 200):
        s += random.choice([0, 0.5, 1, 2, 2.5, 6])
        rows.append((n, None if random.random() < 0.1 else s - random.choice([0, 0, 3]), random.choice(["1", "2", None])))
    e = events(spark, [(n, s, "Info", None, "m", {"ThreadId": t} if t else {}) for n, s, t in rows])
    made = blocks.blocks_by_proximity(e, 2_000_000, 4).groupBy("block_id").agg(F.sort_array(F.collect_list("line_number")).alias("l"))
    assert {tuple(r.l) for r in made.collect()} == sequential(rows, 2, 4)


def test_blocks_by_correlation(spark):
    e = events(spark, [(n, n, "Error" if n == 5 else "Info", None, f"m{n}", {"Id": "a" if n in (1, 5, 40) else "b"} if n != 3 else {"Id": ""}) for n in [1, 2, 3, 4, 5, 30, 31, 40]])
    rows = {r.block_id: r for r in blocks.block_summary(blocks.blocks_by_correlation(e, "Id"), 2).collect()}
    assert sorted((r.first_line, r.last_line, r.lines, r.has_error, tuple(r.samples)) for r in rows.values()) == [(1, 40, 3, True, ("m1", "m5")), (2, 31, 4, False, ("m2", "m4"))]
    quiet = blocks.blocks_by_correlation(e, "Id", quiet=10, sweep=2).groupBy("block_id").agg(F.sort_array(F.collect_list("line_number")).alias("l"))
    assert sorted(r.l for r in quiet.collect()) == [[1, 5], [2, 4, 30, 31], [40]]
    made = blocks.blocks_by_correlation(e, "Id")
    assert blocks.block_containing(made, 31).first()[0] == "s\x1fb\x1f2"
    near = events(spark, [(n, s, "I", None, "m", {"ThreadId": t}) for n, s, t in ((1, 0, "1"), (2, 5, "1"), (3, 6, "1"), (4, None, "1"), (5, 6, "2"))])
    assert [r.line_number for r in blocks.anchor_block(near, 3).collect()] == [2, 3, 4] and blocks.anchor_block(near, 99).count() == 0
    assert [r.line_number for r in blocks.anchor_block(near, 0, field="ThreadId", value="2").collect()] == [5]


def test_alignment(spark):
    assert blocks.align_keys(list("abc"), list("axc")) == [(0, 0), (1, None), (None, 1), (2, 2)]
    assert blocks.align_keys([], ["x"]) == [(None, 0)] and blocks.align_keys(list("ab"), list("ba"))[0] == (0, None)
    assert blocks.align_keys(list("abcd"), list("bcd"), cells=0) == [(0, None), (1, 0), (2, 1), (3, 2)] and blocks.align_keys(list("x"), list("y"), cells=0) == [(0, None), (None, 0)]
    assert blocks.dice(list("ABC"), list("AB")) == 0.8 and blocks.dice([], ["a"]) == 0.0
    left = events(spark, [(1, 1, "I", "a {X}", "a 1", {"X": "1"}), (2, 2, "I", "b", "b", {})])
    right = events(spark, [(7, 1, "I", "a {X}", "a 2", {"X": "2"}), (8, 2, "I", "c", "c", {})])
    assert [(r.kind, r.left_line, r.right_line, r.values_differ) for r in blocks.align(left, right).orderBy("pos").collect()] == [("Common", 1, 7, True), ("OnlyInLeft", 2, None, False), ("OnlyInRight", None, 8, False)]


def test_similar_blocks(spark):
    rows, n = [], 0
    for block, keys in (("b1", "ABC"), ("b2", "AXC"), ("b3", "XYZ"), ("b4", "AB")):
        for k in keys:
            n += 1
            rows.append((n, n, "I", k, k, {"B": block}))
    made = blocks.blocks_by_correlation(events(spark, rows), "B")
    anchor = events(spark, [(i, i, "I", k, k, {}) for i, k in enumerate("ABC", 1)])
    assert [(r.block_id.split("\x1f")[1], r.score) for r in blocks.similar_blocks(anchor, made, 2).collect()] == [("b1", 1.0), ("b4", 0.8)]


# ---- traces, highlights, alerts, grid, annotations --------------------------------------------------------------


def test_traces(spark):
    start = lambda s: f"2026-01-01T00:00:{s:02d}Z"
    e = events(spark, [
        (1, 5, "I", None, "root", {"SpanStartTimestamp": start(0)}, None, "t", "a"), (2, 4, "I", None, "kid", {"SpanStartTimestamp": start(1), "ParentSpanId": "a"}, None, "t", "b"),
        (3, 4, "I", None, "again", {"SpanStartTimestamp": start(2), "ParentSpanId": "a"}, None, "t", "b"), (4, 9, "I", None, "orphan", {"SpanStartTimestamp": start(8), "ParentSpanId": "zz"}, None, "u", "c"), (5, 9, "I", None, "no span", {}, None, "u", "d"),
    ])
    assert values(traces.trace_summary(e), "trace_id", "spans", "first_line") == [("u", 1, 4), ("t", 3, 1)]
    rows = {(r.trace_id, r.span_id): r for r in traces.trace_tree(e).collect()}
    assert rows["t", "b"].path == ["a", "b"] and rows["t", "b"].message == "kid" and rows["t", "a"].n_desc == 1 and rows["u", "c"].depth == 0 and rows["t", "a"].duration_us == 5_000_000 and len(rows) == 3
    assert traces.trace_tree(e, "u").count() == 1


def test_highlight(spark):
    presets = [highlight.Preset("p", (highlight.Rule("off", "a", enabled=False), highlight.Rule("field", "a", target="Missing"), highlight.Rule("word", "AB"), highlight.Rule("rx", "[0-9]*", True))), highlight.Preset("q", (highlight.Rule("later", "b"),))]
    e = events(spark, [(1, 1, "I", None, "ab AB", {}), (2, 1, "I", None, "x 12", {}), (3, 1, "I", None, None, {})]).withColumn("text", F.col("message"))
    rows = {r.line_number: r for r in highlight.with_spans(e, presets).collect()}
    assert rows[1].rule_id == "word" and [(s.start, s.length) for s in rows[1].spans] == [(0, 2), (3, 2)]
    assert rows[2].rule_id == "rx" and [(s.start, s.length) for s in rows[2].spans] == [(2, 2)] and rows[3].rule_id is None


def test_alerts(spark):
    rule = highlight.Rule("r", "x", threshold=3, window_us=60_000_000)
    hits = lambda seconds: spark.createDataFrame([("r", dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)], "rule_id string, ts timestamp, line_number long")
    assert [r.line_number for r in highlight.threshold_alerts(hits([0, 1, 2, 3]), [rule]).collect()] == [2]
    random.seed(2)
    times, s = [], 0
    for _ in range(500):
        s += random.choice([0, 1, 20, 59, 61, 100])
        times.append(s)
    counter, expected = highlight.HitWindow(3, 60_000_000), []
    for i, s in enumerate(times):
        if counter.record(s * 1_000_000):
            expected.append(i)
    assert sorted(r.line_number for r in highlight.threshold_alerts(hits(times), [rule]).collect()) == expected
    assert highlight.threshold_alerts(hits([1]), []).count() == 0
    for threshold, times in ((1, [0, 5]), (4, list(range(300))), (5, sorted(random.choice(range(400)) for _ in range(300)))):  # a rule that never rests
        counter = highlight.HitWindow(threshold, 20_000_000)
        expected = [i for i, s in enumerate(times) if counter.record(s * 1_000_000)]
        given = hits(times).union(hits(times).limit(0)).repartition(3)
        rule = highlight.Rule("r", "x", threshold=threshold, window_us=20_000_000)
        assert sorted(r.line_number for r in highlight.threshold_alerts(given, [rule]).collect()) == expected


def test_grid(spark):
    e = events(spark, [(1, 1, "I", None, "m", {"N": "10"}), (2, 2, "I", None, "m", {"N": "9"}), (3, 3, "I", None, "other", {}), (4, None, "E", None, "m", {"N": "x"})])
    got = lambda *a, **k: [r.line_number for r in grid.grid(e, ["N"], *a, **k).collect()]
    assert got() == [1, 2, 3, 4] and got(sort="N") == [2, 1, 4, 3] and got(sort="N", descending=True)[-1] == 3 and got(sort="Time") == [1, 2, 3, 4]
    assert got((grid.ValueFilter("N", None),)) == [3] and got((grid.ValueFilter("N", "9", True),)) == [1, 3, 4] and got(search="OTHER") == [3] and got(search="10") == [1]
    assert grid.default_columns(e) == ["N"] and grid.grid(e, ["Level"]).columns == ["line_number", "ts", "level", "property:Level", "message"]


def test_annotations_and_report(spark):
    ls = lines(spark, [*TRACES, "a `tick` | <b>"])
    marks = spark.createDataFrame([("s", 2, "n"), ("s", 99, None)], "source string, line_number long, note string")
    assert values(annotations.bookmarks(ls, marks), "line_number", "text") == [(2, TRACES[1]), (99, None)]
    from cordwood.functions.text import text_hash

    h = ls.select("line_number", text_hash(F.col("text")).alias("h")).collect()[0].h
    noted = spark.createDataFrame([("s", 1, "ok", h), ("s", 2, "old", "0")], "source string, line_number long, note string, text_hash string")
    assert sorted(values(annotations.notes(ls, noted), "line_number", "line_changed")) == [(1, False), (2, True)]
    assert [annotations.next_mark(marks, n, f).first()[0] for n, f in ((2, True), (99, True), (2, False))] == [99, 2, 99]
    assert sorted(values(annotations.merge_windows(spark.createDataFrame([(1,), (5,), (12,)], "line_number long"), 2, 13), "first", "last")) == [(1, 7), (10, 13)]
    report = annotations.build_report(ls, "T*", "s", [2], [{"line_number": 1, "text_hash": h, "note": "look"}, {"line_number": 2, "text_hash": "0", "note": "stale"}], [20], now=dt.datetime(2026, 1, 1))
    assert [[x["number"] for x in e] for e in report.excerpts] == [[1, 2, 3, 4], [18, 19, 20]] and report.note_count == 1 and report.total_groups == 4
    md, page = annotations.report_markdown(report), annotations.report_html(report)
    assert "# Incident report — T\\*" in md and "**Line 1:** look" in md and "stale" not in md and "> 20  a `tick` | <b>" in md and "&lt;b&gt;" in page and "System.InvalidOperationException" in page
    assert "No marked lines" in annotations.report_markdown(annotations.build_report(ls, "x", "s")) and annotations.new_note(" x ", True) == "[AI] x"


def test_exports(spark):
    e = events(spark, [(1, 1, "Error", None, "m", {"a": "b"}, "X: y")])
    ls = lines(spark, ["raw", "second"])
    assert values(annotations.export_formatted(ls, e), "value") == [("2026-01-01 00:00:01.000 [Error] m\nX: y",), ("second",)]
    out = [r.value for r in annotations.export_json(ls, e).collect()]
    assert '"message":"m"' in out[0] and out[1] == '{"lineNumber":2,"text":"second"}' and values(annotations.export_text(ls), "value") == [("raw",), ("second",)]
