"""Every query of the subpackage plans and runs on the smallest tables, and those with SQL agree with it."""

import duckdb
import pytest

from conftest import DATA
from cordwood.llm import queries as Q

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    if name in Q.ORACLES:
        duck = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        result = duck.execute(Q.ORACLES[name])
        names = [d[0] for d in result.description]
        assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    else:
        assert columns
