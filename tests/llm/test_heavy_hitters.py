from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from cordwood.llm import heavy_hitters as H

SCHEMA = "kind string, signature string, low int"


@given(st.lists(st.integers(0, 30), max_size=600), st.integers(1, 50))
def test_counts_lie_in_their_intervals(items, step):
    c = H.LossyCounter(0.05)
    for at in range(0, len(items), step):
        part = Counter(items[at : at + step])
        c.add(list(part), list(part.values()), sum(part.values()))
    true = Counter(items)
    for x, n in true.items():
        count, missed = c.entries.get(x, [0, c.bucket])
        assert count <= n <= count + max(missed, c.bucket)
        assert n <= 0.05 * len(items) + 1 or x in c.entries
    assert len(c.entries) <= 20 * 20


def rows(counts, kind="k"):
    return [(kind, s, 0) for s, n in counts.items() for _ in range(n)]


def exact(data):
    total = Counter(k for k, _, _ in data)
    return {(k, s) for (k, s), n in Counter((k, s) for k, s, _ in data).items() if s and n * 200 >= total[k]}


def test_found_equals_exact_counting(spark):
    data = rows({f"r{i}": 1 for i in range(3000)} | {"hot": 2000, "edge": 30, "below": 20, "": 400, None: 600})
    data += rows({f"x{i}": 2 for i in range(50)} | {"É ": 3}, "other") + rows({"only": 1}, None)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert {tuple(r) for r in H.found(df).collect()} == exact(data)
    for r in H.frequent(df, "kind", "signature").collect():
        assert r.low <= Counter((k, s) for k, s, _ in data)[(r.kind, r.signature)] <= r.high


def test_threshold_is_met_exactly(spark):
    data = rows({f"r{i}": 1 for i in range(1980)} | {"at": 10, "under": 9, "pad": 1})
    assert {tuple(r) for r in H.found(spark.createDataFrame(data, SCHEMA)).collect()} == {("k", "at")}


def test_empty_and_long(spark):
    assert H.found(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.found(spark.createDataFrame([("k", "x" * 200_000, 1)] * 3, SCHEMA)).count() == 1
