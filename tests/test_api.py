import pytest

from cordwood.api import Logs, open_document


@pytest.fixture(scope="module")
def logs(spark):
    texts = [f'{{"@t":"2026-01-01T00:00:{i:02d}Z","@mt":"Job {{JobId}} step {i % 3}","@l":"{"Error" if i == 5 else "Information"}","JobId":"j{i // 5}","SourceContext":"S{i % 2}"}}' for i in range(20)]
    texts[7] = '{"@t":"2026-01-01T00:00:07Z","@m":"broke","@l":"Error","@x":"A.BException: z\\n   at C.D()"}'
    ls = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "source string, line_number long, text string")
    marks = spark.createDataFrame([("d", 3, "m")], "source string, line_number long, note string")
    notes = spark.createDataFrame([], "source string, line_number long, note string, text_hash string")
    alerts = spark.createDataFrame([("r", 1, 1), ("r", 5, 2)], "rule_id string, at_us long, line_number long")
    return Logs([open_document("d", ls)], marks, notes, alerts)


def test_every_question(logs):
    assert logs.list_open_documents() == [{"name": "d", "format": "serilog"}]
    said = logs.describe_source("d", 2)
    assert said["lines"] == 20 and said["is_serilog"] and len(said["first_lines"]) == 2
    assert [r.name for r in logs.list_structured_properties("d").collect()] == ["JobId", "SourceContext"]
    rows, more = logs.search("d", "broke")
    assert [r.line_number for r in rows.collect()] == [8] and not more and logs.search("d", "Job", most=3)[1]
    assert logs.get_line_context("d", 5, 1, 1).count() == 3 and logs.top_patterns("d").first()["count"] == 7
    wanted = logs.top_patterns("d").first().signature
    assert logs.pattern_occurrences("d", wanted, 2).count() == 2
    assert [r.value for r in logs.top_error_sources("d").collect()] == ["S1", "C.D"] and logs.top_property_values("d", "JobId").count() == 4
    assert logs.scan_blocks("d", "JobId").count() == 4 and logs.scan_blocks("d").count() == 1 and logs.find_similar_blocks("d", 2, field="JobId").first().score == 1.0
    groups = logs.exception_groups("d").collect()
    assert [(g.type, g.lines) for g in groups] == [("A.BException", [8])]
    assert [r.line_number for r in logs.get_bookmarks("d").collect()] == [3] and logs.get_new_lines_since("d", 18).count() == 2
    rows, more = logs.query_time_range("d", "-5s", None)
    assert rows.count() == 6 and not more
    assert [r.line_number for r in logs.get_alerts().collect()] == [2, 1]


def test_writing(logs):
    logs.add_bookmark("d", 9, "b")
    logs.add_note("d", 4, " seen ")
    assert [r.line_number for r in logs.get_bookmarks("d").collect()] == [3, 9]
    assert [(r.note, r.line_changed) for r in logs.get_notes("d").collect()] == [("[AI] seen", False)]
    with pytest.raises(ValueError):
        logs.query_time_range("d", "whenever", None)
    with pytest.raises(KeyError):
        logs.search("none", "x")
