"""Parent-child links to full hierarchies (problem 5).

Links stay within a scope (a trace), so the scopes are what is spread. A scope of at most SCOPE_NODES rows, and so with
a bounded need of memory, is resolved where it lies: level-wise frontiers go out from the roots, all scopes of a batch
at once, and extend root, depth and path by joins of sorted codes; sums come back level by level; what no frontier
reaches is on or below a loop. One exchange of the links is all that is needed.

Larger scopes, of which no task could hold the rows, are resolved by joins of the whole table on doubling levels: after
round k every node knows the ancestor 2^k levels up (its jump), the distance to it, and how many nodes lie below it
within fewer than 2^k levels, so a chain of d levels takes log2(d) rounds. Nodes that are done leave the rounds. Both
ways give the same rows, which a test shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.session import cut

MAX_ROUNDS = 40  # 2^40 levels
SCOPE_NODES = 250_000  # rows of a scope that one task resolves


def links(df: DataFrame, node: Column, parent: Column, scope: Column, order: Column) -> DataFrame:
    """scope, node, parent, order: what a hierarchy is made of, one row per mention of a node.

    Rows with null node or scope are dropped. Of several rows of a node the one with the smallest order (nulls last)
    counts, ties take the smallest parent, nulls first; a null or unknown parent makes a root.
    """
    return df.select(scope.alias("scope"), node.alias("node"), parent.alias("parent"), order.cast("long").alias("order")).where("node is not null and scope is not null")


def _frontiers(scope: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(root, depth, frontiers) of nodes given by codes: parent is the parent's code or -1; root and depth are -1 for
    nodes that no frontier reaches."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")  # children stand together, in order of their parents
    ends = np.searchsorted(parent[order], np.arange(n + 1))
    root, depth = np.full(n, -1, "int64"), np.full(n, -1, "int64")
    now = np.flatnonzero(parent < 0)
    root[now], depth[now] = now, 0
    found = []
    while len(now):
        found.append(now)
        lo, hi = ends[now], ends[now + 1]
        count = hi - lo
        kids = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        root[kids], depth[kids] = np.repeat(root[now], count), depth[np.repeat(now, count)] + 1
        now = kids
    return root, depth, found


def _on_loop(parent: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Which of the lost nodes are on a loop: those left when nodes without children are taken off again and again."""
    kids = np.bincount(parent[lost], minlength=len(parent)) if len(lost) else np.zeros(len(parent), int)
    loop = np.zeros(len(parent), bool)
    loop[lost] = True
    now = lost[kids[lost] == 0]
    while len(now):
        loop[now] = False
        up, n = np.unique(parent[now], return_counts=True)
        kids[up] -= n
        now = up[(kids[up] == 0) & loop[up]]
    return loop


def _batch(pdf: pd.DataFrame, form: str) -> pd.DataFrame:
    """The resolved nodes of whole scopes, in the form wanted: rows, paths or pairs."""
    pdf = pdf.sort_values(["scope", "node", "order", "parent"], na_position="last", kind="stable")
    if pdf["order"].isna().any() or pdf.duplicated(["scope", "node", "order"]).any():
        pdf = pdf.assign(_p=pdf["parent"].fillna(""), _o=pdf["order"].isna()).sort_values(["scope", "node", "_o", "order", "_p"], kind="stable")
    pdf = pdf.drop_duplicates(["scope", "node"])
    scopes, _ = pd.factorize(pdf["scope"])
    key = pd.MultiIndex.from_arrays([scopes, pdf["node"]])
    at = key.get_indexer(pd.MultiIndex.from_arrays([scopes, pdf["parent"].fillna("")]))
    at = np.where(pdf["parent"].isna().to_numpy(), -1, at)
    root, depth, frontiers = _frontiers(scopes, at)
    node, parent = pdf["node"].to_numpy(object), np.where(at >= 0, pdf["parent"].to_numpy(object), None)
    if form == "pairs":  # ancestor pairs, frontier by frontier: those of the parents, one further, and the parents
        above: dict[int, np.ndarray] = {}
        out = []
        for front in frontiers:
            fresh = {}
            for i in front.tolist():
                fresh[i] = np.append(above[at[i]], at[i]) if at[i] >= 0 else np.zeros(0, "int64")
            above = fresh
            sizes = np.array([len(v) for v in fresh.values()])
            if sizes.sum():
                below = np.repeat(np.fromiter(fresh, "int64"), sizes)
                up = np.concatenate(list(fresh.values()))
                out.append(pd.DataFrame({"scope": pdf["scope"].to_numpy(object)[below], "ancestor": node[up], "node": node[below], "distance": (depth[below] - depth[up]).astype("int32")}))
        return pd.concat(out) if out else pd.DataFrame({"scope": [], "ancestor": [], "node": [], "distance": np.zeros(0, "int32")})
    n_desc = np.zeros(len(pdf), "int64")
    for front in reversed(frontiers[1:]):
        np.add.at(n_desc, at[front], n_desc[front] + 1)
    lost = np.flatnonzero(depth < 0)
    loop = _on_loop(at, lost)
    state = np.full(len(pdf), "tree", object)
    state[lost] = "below"
    state[loop] = "cycle"
    n_desc[lost] = -1
    out = pd.DataFrame({
        "scope": pdf["scope"].to_numpy(object), "node": node, "parent": parent, "root": np.where(depth >= 0, node[root], None),
        "depth": depth.astype("int32"), "n_desc": n_desc.astype("int32"), "state": state,
    })
    if form == "paths":
        paths: list = [None] * len(pdf)
        for front in frontiers:
            for i in front.tolist():
                paths[i] = [*paths[at[i]], node[i]] if at[i] >= 0 else [node[i]]
        out["path"] = paths
    return out


_ROWS = "scope string, node string, parent string, root string, depth int, n_desc int, state string"
_FORMS = {"rows": _ROWS, "paths": _ROWS + ", path array<string>", "pairs": "scope string, ancestor string, node string, distance int"}


def _in_place(rows: DataFrame, form: str, most: int) -> DataFrame:
    """Scopes of a bounded number of rows, each resolved in the task that holds it, many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            held.append(pdf)
            if sum(map(len, held)) < 100_000:
                continue
            both = pd.concat(held, ignore_index=True)
            last = (both["scope"] == both["scope"].iat[-1]).to_numpy()  # it may go on in the next batch
            held = [both[last]]
            if not last.all():
                yield _batch(both[~last], form)
        if held:
            yield _batch(pd.concat(held, ignore_index=True), form)

    return rows.repartition("scope").sortWithinPartitions("scope").mapInPandas(run, _FORMS[form])


def _large(rows: DataFrame, most: int) -> DataFrame:
    """Scopes with more rows than one task resolves; rows are counted as they stand, before copies go."""
    return rows.groupBy("scope").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("scope")


def resolve(nodes: DataFrame, with_path: bool = False, most: int | None = None) -> DataFrame:
    """scope, node, parent, root, depth, n_desc, state (and path, root first, with_path).

    nodes: as links() gives them. state is tree, cycle (the node is its own ancestor) or below (an ancestor is);
    for the last two root is null and depth and n_desc are -1. An empty table gives an empty result.
    """
    return _resolved(nodes, "paths" if with_path else "rows", SCOPE_NODES if most is None else most)


def _resolved(nodes: DataFrame, form: str, most: int) -> DataFrame:
    large = cut(_large(nodes, most))  # at most one scope for most rows
    if large.isEmpty():
        return _in_place(nodes, form, most)
    small = _in_place(nodes.join(large, "scope", "left_anti"), form, most)
    big = _doubled(nodes.join(large, "scope", "left_semi"), form != "rows")
    return small.unionByName(_pairs(big) if form == "pairs" else big)


def _known(rows: DataFrame) -> DataFrame:
    """scope, node, parent: one row per node, parent null unless it is a node too."""
    nodes = rows.groupBy("scope", "node").agg(F.min(F.struct(F.col("order").isNull(), "order", "parent")).getField("parent").alias("parent"))
    known = nodes.select(F.col("scope").alias("_s"), F.col("node").alias("_n"))
    joined = nodes.join(known, (F.col("scope") == F.col("_s")) & (F.col("parent") == F.col("_n")), "left")
    return joined.select("scope", "node", F.col("_n").alias("parent"))


def _doubled(rows: DataFrame, with_path: bool) -> DataFrame:
    """resolve() by joins on doubling levels. Open nodes, those whose jump has not left the tree, are all that a round
    joins and writes; what lies below a node is added up over the rounds in a table of its own."""
    path = ["path"] if with_path else []
    now = cut(_known(rows).select(
        "scope", "node", "parent", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), *([F.array("node").alias("path")] if with_path else []),
    ))
    below = cut(now.select("scope", "node", F.lit(1).cast("long").alias("below")))
    done = [now.where("jump is null")]
    open_, last = now.where("jump is not null"), None
    for _ in range(MAX_ROUNDS):
        left, image = open_.agg(F.count("*"), F.countDistinct("scope", "jump")).first()
        if not left or (left, image) == last:
            break
        last = (left, image)
        more = open_.join(below, ["scope", "node"]).groupBy("scope", F.col("jump").alias("node")).agg(F.sum("below").alias("_more"))
        below = cut(below.join(more, ["scope", "node"], "left").select("scope", "node", (F.col("below") + F.coalesce("_more", F.lit(0))).alias("below")))
        every = open_
        for part in done:
            every = every.unionByName(part)
        ahead = every.select(F.col("scope").alias("_s"), F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
        step = open_.join(ahead, (F.col("scope") == F.col("_s")) & (F.col("jump") == F.col("_n")))
        step = cut(step.select(
            "scope", "node", "parent", F.col("_jump").alias("jump"), F.coalesce("root", "_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"),
            *([F.concat("_path", "path").alias("path")] if with_path else []),
        ))
        done.append(step.where("jump is null"))
        open_ = step.where("jump is not null")
    loops = open_.select("scope", F.col("jump").alias("node"), F.lit(True).alias("_loop")).distinct()
    every = open_
    for part in done:
        every = every.unionByName(part)
    lost = F.col("jump").isNotNull()
    return every.join(below, ["scope", "node"]).join(loops, ["scope", "node"], "left").select(
        "scope", "node", "parent", F.when(~lost, F.col("root")).alias("root"),
        F.when(lost, -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.when(lost, -1).otherwise(F.col("below") - 1).cast("int").alias("n_desc"),
        F.when(~lost, "tree").when(F.col("_loop"), "cycle").otherwise("below").alias("state"),
        *([F.when(~lost, F.col("path")).alias("path")] if with_path else []),
    )


def _pairs(trees: DataFrame) -> DataFrame:
    up = F.posexplode(F.reverse(F.slice("path", 1, F.size("path") - 1)))
    found = trees.where("state = 'tree' and depth > 0").select("scope", "node", up.alias("_i", "ancestor"))
    return found.select("scope", "ancestor", "node", (F.col("_i") + 1).cast("int").alias("distance"))


def descendants(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """scope, ancestor, node, distance: every pair of a node and one above it, loops left out.

    The pairs of a frontier are those of its parents, one level further, and the parents themselves. The result has as
    many rows as the nodes have ancestors, which is its nature.
    """
    return _resolved(nodes, "pairs", SCOPE_NODES if most is None else most)


def _clean(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))), F.lit(""))


def span_links(spans: DataFrame) -> DataFrame:
    """links() of trace spans: ids trimmed and in lower case, an empty or all-zero parent is none."""
    spans = spans.where("start_ts is not null")
    parent = _clean("parent_span_id")
    return links(spans, _clean("span_id"), F.when(~parent.rlike("^0+$"), parent), _clean("trace_id"), F.col("row_id"))


def found(spans: DataFrame, most: int | None = None) -> DataFrame:
    """trace_id, span_id, root_span_id ('' without one), depth, n_desc, state of every span of a trace."""
    return resolve(span_links(spans), most=most).select(
        F.col("scope").alias("trace_id"), F.col("node").alias("span_id"),
        F.when(F.col("state") == "tree", F.col("root")).otherwise("").alias("root_span_id"), "depth", "n_desc", "state",
    )


def below(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, descendant_id, distance (in levels): every span that has a root with each span below it."""
    return descendants(span_links(spans)).select(
        F.col("scope").alias("trace_id"), F.col("ancestor").alias("span_id"), F.col("node").alias("descendant_id"), "distance"
    )


def paths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, path (ids from the root joined by /) of every span that has a root."""
    return resolve(span_links(spans), with_path=True).where("state = 'tree'").select(
        F.col("scope").alias("trace_id"), F.col("node").alias("span_id"), F.array_join("path", "/").alias("path")
    )
