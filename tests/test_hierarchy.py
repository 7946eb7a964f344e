import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cordwood.operators import hierarchy as H
from pyspark.sql import functions as F

SCHEMA = "row_id long, trace_id string, span_id string, parent_span_id string, start_ts timestamp, extra int"


def brute(rows):
    """(trace, span) -> (root, depth, n_desc, state) by walking up."""
    clean = lambda x: (x or "").strip().lower()
    parent = {}
    for _, t, s, p, start, *_ in sorted(rows, key=lambda r: r[0]):
        if start is not None and clean(t) and clean(s):
            parent.setdefault((clean(t), clean(s)), clean(p))
    up = {k: ((k[0], p) if p.strip("0") and (k[0], p) in parent else None) for k, p in parent.items()}
    out, below = {}, dict.fromkeys(up, 0)
    for k in up:
        seen, x = [], k
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is None:
            out[k] = [seen[-1][1], len(seen) - 1, 0, "tree"]
            for y in seen[1:]:
                below[y] += 1
        else:
            out[k] = ["", -1, -1, "cycle" if x == k else "below"]
    return {(*k, v[0], v[1], below[k] if v[3] == "tree" else -1, v[3]) for k, v in out.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in H.found(df).collect()} == brute(rows)
    assert {tuple(r) for r in H.found(df, 2).collect()} == brute(rows)  # scopes of more than two rows by doubling joins


def test_shapes(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    rows = [(i, "t", f"{i:x}", f"{i - 1:x}" if i else None, at, 0) for i in range(70)]  # a chain
    rows += [(100 + i, "w", f"c{i}", "c0" if i else "0000000000000000", at, 0) for i in range(50)]  # a wide tree
    rows += [(200 + i, "l", f"l{i}", f"l{(i + 1) % 3}", at, 0) for i in range(3)]  # a loop
    rows += [(210 + i, "l", f"b{i}", f"b{i - 1}" if i else "l0", at, 0) for i in range(9)]  # below it
    rows += [(300, "l", "self", "self", at, 0), (301, "l", "x", "gone", at, 0), (302, " L ", " X ", "l0", at, 0), (303, None, "q", None, at, 0), (304, "l", "m", None, None, 0), (305, "l", "", None, at, 0)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["t", "u", None]), st.integers(0, 12), st.integers(-1, 14)), max_size=25))
def test_random(spark, edges):
    import datetime as dt

    check(spark, [(i, t, f"s{a}", f"s{b}" if b >= 0 else None, dt.datetime(2025, 1, 1), 1) for i, (t, a, b) in enumerate(edges)])


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a")], "s string, n string, p string")
    nodes = H.links(df, F.col("n"), F.col("p"), F.col("s"), F.lit(0))
    rows = {r.node: (r.path, r.depth, r.n_desc) for r in H.resolve(nodes, with_path=True).collect()}
    assert rows == {"a": (["a"], 0, 3), "b": (["a", "b"], 1, 1), "c": (["a", "b", "c"], 2, 0), "d": (["a", "d"], 1, 0)}
    assert {r.node: (r.path, r.depth, r.n_desc) for r in H.resolve(nodes, with_path=True, most=1).collect()} == rows
    for most in (None, 1):
        assert {tuple(r) for r in H.descendants(nodes, most).collect()} == {("t", "a", "b", 1), ("t", "b", "c", 1), ("t", "a", "c", 2), ("t", "a", "d", 1)}


def test_empty(spark):
    assert H.found(spark.createDataFrame([], SCHEMA)).count() == 0
