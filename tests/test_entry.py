"""The driver's contract: every query plans and runs on the smallest tables, and those with SQL agree with it."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from conftest import DATA

spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
CORE = [n for n, f in entry.queries().items() if ".llm." not in f.__module__]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    if name in entry.oracle_sql():
        result = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_export_has_every_event(spark, duck):
    rows = entry.queries()["export_formatted"](spark, str(DATA)).collect()
    events, without = duck.execute("SELECT count(*), count(*) FILTER (ts IS NULL) FROM (SELECT DISTINCT ON (source, line_number) * FROM log_events)").fetchone()
    assert len(rows) == events and sum(r.value.startswith("[") for r in rows) >= without > 0


def test_descendants_are_those_counted(spark):
    q = entry.queries()
    counted = {(r.trace_id, r.span_id): r.n_desc for r in q["p5_found"](spark, str(DATA)).where("n_desc > 0").collect()}
    listed = q["p5_descendants"](spark, str(DATA)).groupBy("trace_id", "span_id").count().collect()
    assert {(r.trace_id, r.span_id): r["count"] for r in listed} == counted
