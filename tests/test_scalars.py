import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cordwood.functions import fields, levels, masking, ordered, text
from cordwood.functions.timequery import parse_time_query

UTC = dt.timezone.utc


def one(spark, column, *values):
    """Values of a column over rows of value v."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v " + ("string" if not values or isinstance(next((v for v in values if v is not None), ""), str) else "long"))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_levels(spark):
    v = F.col("v")
    assert one(spark, levels.normalize_level(v), "trc", " Warn ", "CRIT", "notice", "weird", "", None, "ALERT") == ["Verbose", "Warning", "Error", "Information", "Weird", "Information", "Information", "Fatal"]
    assert one(spark, levels.severity(v), "vrb", "Fatal", "Trace", None) == [0, 5, None, None]
    assert one(spark, levels.guess_severity(v), "an error after INFO", "fine", "informative", "[WRN] x", "PANIC", None) == [4, None, None, 3, 5, None]
    assert one(spark, levels.syslog_level(v), 0, 3, 4, 6, 7) == ["Fatal", "Error", "Warning", "Information", "Debug"]
    assert one(spark, levels.http_level(v), 200, 404, 500) == ["Information", "Warning", "Error"]


def test_mask(spark):
    cases = {
        "User 42 in 120ms took 3.5%": "User <num> in <num>ms took <num>%", "id 6f9619ff-8b86-d011-b42d-00cf4fc964ff at 10.0.0.1": "id <guid> at <ip>", "at 2026-01-02T03:04:05.1Z or 12:30:00": "at <datetime> or <time>",
        "say \"a b\" and 'c'": "say <str> and <str>", "0xFF abc12345 pay_632084  x ": "<hex> <id> pay_<num> x", "": "",
    }
    assert one(spark, masking.mask(F.col("v")), *cases, None) == [*cases.values(), ""]


def test_signature(spark):
    df = spark.createDataFrame([("Error", "t {A}", "m", {"b": "1"}), (None, "", "m 1", {"b": "1", "a": "2"}), ("Info", None, None, None)], "l string, t string, m string, p map<string,string>")
    got = [r[0] for r in df.select(masking.signature(F.col("l"), F.col("t"), F.col("m"), F.col("p"))).collect()]
    assert got == ["Error\x1ft {A}", "\x1fm <num>\x1fa,b", "Info\x1f\x1f"]


def test_deltas_and_durations(spark):
    us = [12_000, 999_999, 1_234_000, -61_000_000, 3_720_000_000, 2 * 86_400_000_000 + 3 * 3_600_000_000, None]
    assert one(spark, text.format_delta(F.col("v")), *us) == ["+12ms", "+999ms", "+1.234s", "-1m01s", "+1h02m", "+2d03h", None]
    assert one(spark, text.format_duration(F.col("v")), 1500, 2_500_000, None) == ["1.5 ms", "2.50 s", None]
    assert one(spark, text.heat(F.col("v")), 0, 10**9, None) == [0.0, 1.0, None]


def test_small_text_functions(spark):
    v = F.col("v")
    assert one(spark, text.text_hash(v), "abc", None) == ["BA7816BF8F01CFEA", None]
    assert one(spark, text.truncate(v, 3), "abc", "abcd", None) == ["abc", "abc…(truncated)", None]
    assert one(spark, text.fuzzy_score(v, F.lit("File tools"), "op"), "Open", "Reopen", "Odd plan", "x") == [1000, 798, 100, None]
    assert one(spark, text.fuzzy_score(v, F.lit("File tools"), "file"), "Open") == [500]
    assert text.build_args("-f {FilePath} -l {LineNumber} {LineText}", "a b", 3, None) == "-f a b -l 3 "
    df = spark.createDataFrame([("b",), ("10",), ("9",), (None,), ("A",), ("12d",)], "v string")
    assert [r.v for r in df.orderBy(*text.natural_sort_keys(v)).collect()] == ["9", "10", "12d", "A", "b", None]
    assert [r.v for r in df.orderBy(*text.natural_sort_keys(v, True)).collect()][-1] is None


def test_frames(spark):
    assert one(spark, fields.top_frame(F.col("v")), "X: y\n   at A.B(Int32 id) in C\n  at D()", "none", None) == ["A.B", None, None]
    frames = ["Shop.Load(Int32 id) in C:\\a.cs:line 42", "a.b.C.run(C.java:17)", "x(y)"]
    assert one(spark, fields.normalize_frame(F.col("v")), *frames) == ["Shop.Load(Int# id)", "a.b.C.run(C.java)", "x(y)"]


def test_correlation(spark):
    texts = ["get request_id=req-8812 trace_id: abc123def user=bob", "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "job-id=\"J77.\" x 6f9619ff-8b86-d011-b42d-00cf4fc964ff", None]
    none = F.lit(None).cast("string")
    got = one(spark, F.to_json(fields.correlation_ids(F.col("v"), none, none, F.create_map(F.lit("UserId"), F.lit("u1"), F.lit("CorrelationId"), F.lit("REQ-8812")))), *texts)
    assert got[0] == '[{"name":"CorrelationId","value":"REQ-8812"},{"name":"trace_id","value":"abc123def"}]'
    assert '"SpanId"' in got[1] and '"TraceId"' in got[1] and '{"name":"job-id","value":"J77"}' in got[2] and '"GUID"' in got[2] and got[3] == '[{"name":"CorrelationId","value":"REQ-8812"}]'
    assert one(spark, fields.is_correlation_key(F.col("v")), "X-Request-Id", "RunId", "Userid", "traceparent") == [True, True, False, True]
    assert one(spark, fields.suggest_fields(F.create_map(*[F.lit(x) for p in (("zId", "1"), ("requestid", "2"), ("TraceId", "3"), ("aGuid", "4"), ("name", "5")) for x in p])), "x") == [["TraceId", "requestid", "aGuid", "zId"]]


def test_text_time(spark):
    got = one(spark, F.unix_micros(fields.text_time(F.col("v"))), "x 2026-01-02T03:04:05,1234567Z y", "2026-01-02 03:04:05+01:30", "12:00:01 z", "none", None, "2026-13-02 03:04:05")
    base = dt.datetime(1970, 1, 1, tzinfo=UTC)
    us = lambda *a: int((dt.datetime(*a, tzinfo=UTC) - base) / dt.timedelta(microseconds=1))
    assert got[:5] == [us(2026, 1, 2, 3, 4, 5, 123456), us(2026, 1, 2, 1, 34, 5), us(2000, 1, 1, 12, 0, 1), None, None]


REF = dt.datetime(2026, 9, 23, 14, 5, tzinfo=dt.timezone(dt.timedelta(hours=2)))


@pytest.mark.parametrize(
    ("typed", "expected"),
    [
        ("-5m", REF - dt.timedelta(minutes=5)), ("+1h30m", REF + dt.timedelta(hours=1.5)), ("-250ms", REF - dt.timedelta(milliseconds=250)), ("14:05:30,5", REF.replace(second=30, microsecond=500000)),
        ("2026-09-23", REF.replace(hour=0, minute=0)), ("2026-09-23T14:05:30.25", REF.replace(second=30, microsecond=250000)), ("2026-09-23 12:05:00Z", REF), ("25:00", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_time_query(typed, expected):
    assert parse_time_query(typed, REF) == expected


def test_relative_needs_a_reference():
    assert parse_time_query("-5m") is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 9))), unique_by=lambda r: r[:2], max_size=30))
def test_running_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, o long, v long")
    out = ordered.running(df, ["k"], "o", lasts={"last": F.col("v")}, sums={"total": F.col("v")}, previous={"before": F.col("v")}, size=7)
    for r in out.collect():
        upto = [v for k, o, v in sorted(rows, key=lambda x: x[1]) if k == r.k and o <= r.o and v is not None]
        past = [v for k, o, v in sorted(rows, key=lambda x: x[1]) if k == r.k and o < r.o and v is not None]
        assert (r["last"], r.total, r.before) == (upto[-1] if upto else None, sum(upto), past[-1] if past else None)
