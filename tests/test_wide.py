import datetime as dt

from cordwood.operators import wide as W

SCHEMA = "row_id long, event_id long, prop_name string, prop_value string, op string, set_at timestamp, prop_type int"
CATALOG = [("RetryCount", "int"), ("CpuShare", "num"), ("IsReplay", "bool"), ("Started", "time"), ("Note", "text")]


def at(n):
    return dt.datetime(2025, 1, 1, 0, 0, n)


def found(spark, rows):
    catalog = spark.createDataFrame(CATALOG, "prop_name string, prop_type string")
    return {tuple(r) for r in W.found(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), catalog).collect()}


def test_values_and_names(spark):
    rows = [
        (1, 1, "retry_count", " +1,009 ", "set", at(1)), (2, 1, "CPU share", "859e-3", "set", at(1)), (3, 1, "is.replay", "Yes", "set", at(1)),
        (4, 1, "STARTED", "2025-01-01T01:00:00+02:00", "set", at(1)), (5, 1, " Note ", "  Été ", "set", at(1)), (6, 2, "RetryCount", "7.0", "set", at(1)),
        (7, 2, "CpuShare", "1,002.436", "set", at(1)), (8, 2, "Started", "1725151544000", "set", at(1)), (9, 3, "Unknown", "x", "set", at(1)), (10, None, "Note", "x", "set", at(1)),
    ]
    assert found(spark, rows) == {
        (1, "RetryCount", "1009"), (1, "CpuShare", "0.859"), (1, "IsReplay", "true"), (1, "Started", "2024-12-31T23:00:00Z"), (1, "Note", "Été"),
        (2, "RetryCount", "7"), (2, "CpuShare", "1002.436"), (2, "Started", "2024-09-01T00:45:44Z"),
    }


def test_unreadable_counts_as_absent(spark):
    bad = {"RetryCount": ["12..5", "many", "NaN", "0x", "--4", "1.5"], "CpuShare": ["NaN", "inf", "1e999", "1.2.3", "?"], "IsReplay": ["2", "maybe"], "Started": ["soon", "0000-00-00"], "Note": ["", "  ", "-", "N/A", "null", None]}
    rows = [(i, i, n, v, "set", at(1)) for i, (n, v) in enumerate((n, v) for n, vs in bad.items() for v in vs)]
    assert found(spark, rows) == set()


def test_latest_row_holds(spark):
    rows = [
        (1, 1, "Note", "old", "set", at(1)), (2, 1, "Note", "new", "set", at(2)), (3, 1, "Note", "-", "set", at(3)), (4, 2, "Note", "a", "set", at(1)), (5, 2, "Note", "b", "set", at(1)),
        (6, 3, "Note", "a", "set", at(1)), (7, 3, "Note", None, "unset", at(2)), (8, 4, "Note", None, "unset", at(1)), (9, 4, "Note", "back", "set", at(2)), (9, 4, "Note", "back", "set", at(2)), (10, 5, "Note", "x", "set", None),
    ]
    assert found(spark, rows) == {(1, "Note", "new"), (2, "Note", "b"), (4, "Note", "back"), (5, "Note", "x")}


def test_wide_types_and_empty(spark):
    catalog = spark.createDataFrame(CATALOG, "prop_name string, prop_type string")
    empty = W.widen(W.cells(spark.createDataFrame([], SCHEMA), catalog), W.header(catalog))
    assert empty.count() == 0 and dict(empty.dtypes) == {"event_id": "bigint", "RetryCount": "bigint", "CpuShare": "double", "IsReplay": "boolean", "Started": "timestamp", "Note": "string"}
    assert found(spark, []) == set()


def test_a_hot_entity(spark):
    rows = [(i, 1, "RetryCount", str(i), "set", at(i % 60)) for i in range(600)]
    assert found(spark, rows) == {(1, "RetryCount", "599")}
