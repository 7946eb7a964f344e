import datetime as dt

import pytest

from cordwood.formats import parsers as P
from cordwood.formats.read import detect_format, is_serilog, join_continuations, parse

UTC = dt.timezone.utc


def test_compact_events():
    e = P.parse_serilog('{"@t":"2026-01-01T00:00:00.1234567+02:00","@mt":"Login {User} {X:0.0} {@Z} {Q}","@l":"Warning","User":"al","X":1.50,"Z":[1, 2],"N":null,"@tr":"t1"}')
    assert e["message"] == "Login al 1.50 [1, 2] {Q}" and e["level"] == "Warning" and e["ts_offset_min"] == 120
    assert e["properties"] == {"User": "al", "X": "1.50", "Z": "[1, 2]", "N": "", "TraceId": "t1"} and e["trace_id"] == "t1"
    assert P.parse_serilog('{"@m":"x"}')["level"] == "Information"
    assert P.parse_serilog("plain") is None and P.parse_serilog('{"a":1}') is None and P.parse_serilog('{"@t":NaN}') is None and P.parse_serilog("{") is None


def test_standard_events():
    e = P.parse_serilog('{"Timestamp":"2026-01-01T09:00:00Z","Level":"Error","MessageTemplate":"a {B}","Exception":"X: y","Properties":{"B":"c","SpanId":"s"}}')
    assert (e["message"], e["exception"], e["span_id"], e["properties"]["B"]) == ("a c", "X: y", "s", "c")
    assert P.parse_serilog('{"RenderedMessage":"r","MessageTemplate":"a"}')["message"] == "r"


def test_ndjson():
    e = P.parse_ndjson('{"level":"info","msg":"one","Message":"two","ts":1726791460040,"error":null,"n":{"b": 1.0}}')
    assert (e["level"], e["message"], e["ts"]) == ("Information", "one", dt.datetime(2024, 9, 20, 0, 17, 40, 40000, UTC))
    assert e["properties"] == {"Message": "two", "error": "", "n": '{"b": 1.0}'}
    assert P.parse_ndjson("[1]") is None and P.parse_ndjson("{}") is None and P.parse_ndjson('{"time":"soon","a":1}')["properties"] == {"time": "soon", "a": "1"}


@pytest.mark.parametrize("line", ["single=pair", "a=1 b=2", "just prose here", '{"a":1}', ""])
def test_logfmt_rejects(line):
    assert P.parse_logfmt(line) is None


def test_logfmt():
    e = P.parse_logfmt('ts=2026-01-02T03:04:05Z level=warn msg="disk\\n\\"full\\"" bare component=storage free=12')
    assert (e["level"], e["message"], e["properties"]) == ("Warning", 'disk\n"full"', {"component": "storage", "free": "12"})
    assert P.parse_logfmt("time=1726791460 level=x")["ts"] == dt.datetime(2024, 9, 20, 0, 17, 40, tzinfo=UTC)


def test_custom_formats():
    assert P.CustomFormat("x", "").validate() and P.CustomFormat("x", "(").validate() and P.CustomFormat("x", "a+").validate()
    e = P.EXAMPLES[2].parser()('1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23')
    assert e["ts"] == dt.datetime(2000, 10, 10, 20, 55, 36, tzinfo=UTC) and e["properties"]["path"] == "/a" and e["level"] is None
    own = P.CustomFormat("d", r"^(?<date>\S+) (?<time>\S+) (?<lvl>\w+) (?<rest>.*)$").parser()("2024-01-02 03:04:05,678 crit all of it")
    assert own["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5, 678000, UTC) and own["level"] == "Error" and own["message"] == "2024-01-02 03:04:05,678 crit all of it"
    assert P.CustomFormat("e", r"(?<ts>\d+) (?<msg>.*)").parser()("1726791460040 x")["ts"].year == 2024


def test_detection():
    assert detect_format(['{"@t":"2026-01-01T00:00:00Z","@m":"a"}'] * 3) == "serilog"
    assert detect_format(['{"level":"info","msg":"one"}'] * 2) == "ndjson"
    assert detect_format(["ts=1 level=warn msg=a"] * 3 + [""]) == "logfmt"
    assert detect_format(["<34>Oct 11 22:14:15 mymachine su: x"] * 2) == "syslog"
    assert detect_format(["#Version: 1.0", "#Fields: date time s-ip", "2026-01-02 03:04:05 10.0.0.1", "2026-01-02 03:04:05 10.0.0.1"]) == "w3c"
    assert detect_format(["plain", "text"]) is None and detect_format([]) is None and detect_format(['{"@m":"a"}']) is None
    assert detect_format(["2024-09-12 11:52:27,477 - a - INFO - b"] * 4, P.EXAMPLES) == "python"
    assert is_serilog(['{"@m":"a"}'] * 4 + ["x"]) and not is_serilog(['{"@m":"a"}'] * 2)


def lines(spark, texts):
    return spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "source string, line_number long, text string")


def test_syslog(spark):
    texts = ['<165>1 2026-01-02T03:04:05.000Z host1 myapp 8710 ID47 [ex@32473 iut="3" eventID="1011"] Application restarted', "<34>Oct 11 22:14:15 mymachine su: 'su root' failed", "<34>Oct  1 22:14:15 m a[1]: x", "none", None]
    rows = {r.line_number: r for r in parse(lines(spark, texts), "syslog", year=2024).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].level == "Information" and rows[2].level == "Fatal"
    assert rows[1].properties == {"facility": "20", "host": "host1", "appname": "myapp", "procid": "8710", "msgid": "ID47", "iut": "3", "eventID": "1011"}
    assert rows[2].properties == {"facility": "4", "host": "mymachine", "tag": "su"} and rows[2].message == "'su root' failed" and rows[3].properties["tag"] == "a[1]"
    assert (rows[3].ts.month, rows[3].ts.day) == (10, 1)


def test_w3c(spark):
    texts = ["x before", "#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query sc-status time-taken", "2026-01-02 03:04:05 10.0.0.1 GET /home - 500 128", "2026-01-02 03:04:05 short", "#Fields: a x-level", '"b c" Warning extra', ""]
    rows = {r.line_number: r for r in parse(lines(spark, texts), "w3c").collect()}
    assert set(rows) == {3, 6} and rows[3].level == "Error" and rows[3].message == "GET /home → 500 (128 ms)" and rows[3].properties["cs-uri-query"] == ""
    assert rows[6].properties == {"a": "b c", "x-level": "Warning"} and rows[6].level == "Warning" and rows[6].message == ""


def test_plain_and_fallback(spark):
    texts = ["2026-02-15 09:00:03.000 [WARN] Gateway slow", '{"@t":"2026-01-01T00:00:00Z","@m":"in json"}', "  ", "at 12:30:01,5 an error and info"]
    rows = {r.line_number: r for r in parse(lines(spark, texts), None).collect()}
    assert set(rows) == {1, 2, 4} and rows[1].level == "Warning" and rows[2].message == "in json" and rows[4].level == "Error"
    assert rows[1].message == texts[0] and (rows[4].ts.year, rows[4].ts.microsecond) == (2000, 500000)


def test_continuations(spark):
    texts = ["more of nothing", "2024-09-12 11:52:27,477 - a - INFO - b", "more", "", "again"]
    ls = lines(spark, texts)
    rows = [(r.owner, r.level) for r in join_continuations(ls, parse(ls, P.EXAMPLES[1])).orderBy("line_number").collect()]
    assert rows == [(None, None), (2, "Information"), (2, "Information"), (None, None), (2, "Information")]


def test_segments():
    assert P.segments("a {X} b {Y}", {"X": "1"}) == [("a ", None), ("1", "X"), (" b {Y}", None)]
