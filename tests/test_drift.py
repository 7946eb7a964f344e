import json

from cordwood.operators import drift as D

SCHEMA = "app string, file_no int, record_no int, payload string, kind string"


def frame(spark, files, app="a"):
    rows = []
    for no, events in files.items():
        for i, e in enumerate(events):
            payload = e if e is None or isinstance(e, str) else json.dumps({"@t": "2025-01-01T00:00:00Z", "@mt": "x", **e})
            rows.append((app, no, i, payload, "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {tuple(r)[1:] for r in D.changes(frame(spark, files)).collect()}


def test_every_kind_of_change(spark):
    files = {
        1: [{"Num": i, "Word": f"w{i % 4}", "Same": True, "Gone": 1.5, "Kind": i} for i in range(12)],
        3: [{"Count": i + 2, "Label": f"w{i % 4}", "Same": False, "Fresh": [1], "Kind": f"{i}"} for i in range(12)],
    }
    assert changes(spark, files) == {
        (3, "renamed", "Num", "Count"), (3, "renamed", "Word", "Label"), (3, "removed", "Gone", ""), (3, "added", "Fresh", ""), (3, "retyped", "Kind", "string"),
    }


def test_other_values_are_no_rename(spark):
    files = {1: [{"A": 100 + i, "W": f"a{i % 3}"} for i in range(9)], 2: [{"B": 9000 + i, "V": f"z{i % 3}"} for i in range(9)]}
    assert changes(spark, files) == {(2, "removed", "A", ""), (2, "removed", "W", ""), (2, "added", "B", ""), (2, "added", "V", "")}


def test_nulls_single_odd_values_and_broken_payloads(spark):
    files = {1: [{"A": 1}, {"A": "?"}, {"A": 2}, {"A": None}, None, "", "# end", '{"@t":1,"Cut'], 2: [{"A": 3, "B": None}, "[1]"], 3: ["", None], 4: [{"A": 1}]}
    assert changes(spark, files) == {(3, "removed", "A", ""), (4, "added", "A", "")}


def test_standard_events_and_names_with_signs(spark):
    standard = lambda p: json.dumps({"Timestamp": "2025-01-01T00:00:00Z", "MessageTemplate": "m", "Properties": p})
    files = {1: [standard({"a.b": 1, "@c": "x"})], 2: [standard({"a.b": 1.5, "@c": "x"})], 3: [{"a.b": 2.5, "@c": "x"}]}
    assert changes(spark, files) == {(2, "retyped", "a.b", "float"), (3, "removed", "@c", "")}


def test_consistent_table(spark):
    rows = {r.record_no: r for r in D.consistent(frame(spark, {1: [{"A": 1, "F": 1.5, "S": "x"}, {"A": 2, "F": 2, "S": 3}, {"A": "no", "F": 0.5, "S": "y", "N": {"k": [1]}}, {}]})).collect()}
    assert rows[0].integers == {"A": 1} and rows[1].floats == {"F": 2.0} and rows[1].texts == {"S": "3"}
    assert rows[2].failed == {"A": "no"} and rows[2].nested == {"N": '{"k":[1]}'} and len(rows) == 4


def test_renamed_fields_are_one(spark):
    files = {1: [{"Num": i} for i in range(9)], 2: [{"Count": i} for i in range(9)], 3: [{"Total": i, "Num": "again"} for i in range(9)]}
    rows = D.consistent(frame(spark, files)).collect()
    assert {tuple(r.integers) for r in rows} == {("Total",)} and {r.texts.get("Num") for r in rows if r.file_no == 3} == {"again"} and len(rows) == 27


def test_typed_columns(spark):
    both = frame(spark, {1: [{"A": 1, "B": "x"}, {"A": "?"}]}).union(frame(spark, {1: [{"A": "text", "C": True}]}, "b")).union(frame(spark, {1: [{"A": 3}]}, "c"))
    table = D.projected(D.consistent(both), 0.6)
    rows = {(r.app, r.record_no): r for r in table.collect()}
    assert [c for c in table.columns if c.startswith("field:")] == ["field:A"] and rows["a", 0]["field:A"] == 1 and rows["a", 0].texts == {"B": "x"}
    assert rows["a", 1].failed == {"A": "?"} and rows["b", 0]["field:A"] is None and rows["b", 0].texts == {"A": "text"} and rows["b", 0].booleans == {"C": True}


def test_names_that_differ_in_case_are_columns_of_their_own(spark, tmp_path):
    names = ("LeaseName", "leaseName", "leasename", "leasename#2")
    both = frame(spark, {1: [{n: i for i, n in enumerate(names)}, {"leaseName": 7}]}).union(frame(spark, {1: [{"leaseName": "text"}]}, "b"))
    D.projected(D.consistent(both), 0.5).write.parquet(str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out"))
    columns = [c for c in table.columns if c.startswith("field:")]
    rows = {(r.app, r.record_no): r for r in table.collect()}
    assert columns == ["field:LeaseName", "field:leaseName#3", "field:leasename#4", "field:leasename#2"]
    assert [rows["a", 0][c] for c in columns] == [0, 1, 2, 3] and rows["a", 0].integers == {} and rows["a", 1]["field:leaseName#3"] == 7
    assert rows["b", 0]["field:leaseName#3"] is None and rows["b", 0].texts == {"leaseName": "text"}


def test_columns_can_be_written_whatever_the_names(spark, tmp_path):
    names = ["", " ", "a b", "a.b", "a`b", "a,b;{c}(d)=", "é", "É", "k", "\u212a", "x\ny", "a/b"]
    D.projected(D.consistent(frame(spark, {1: [{n: i for i, n in enumerate(names)}]}))).write.parquet(str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert sorted(v for c, v in row.asDict().items() if c.startswith("field:")) == list(range(len(names)))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.changes(empty).count() == 0 and D.consistent(empty).count() == 0
