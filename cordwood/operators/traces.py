"""Traces: summaries and span trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.functions.fields import with_span_columns
from cordwood.operators.hierarchy import links, resolve


def spans(events: DataFrame) -> DataFrame:
    """The events that are spans, with their span columns."""
    return with_span_columns(events).where("is_span")


def trace_summary(events: DataFrame) -> DataFrame:
    """trace_id, spans (copies counted), start, first_line; newest first, then line from the bottom."""
    found = spans(events).groupBy("trace_id").agg(F.count("*").alias("spans"), F.min("span_start").alias("start"), F.min("line_number").alias("first_line"))
    return found.orderBy(F.desc("start"), F.desc("first_line"), "trace_id")


def trace_tree(events: DataFrame, trace_id: str | None = None) -> DataFrame:
    """trace_id, span_id, parent_span_id (null for roots), root, depth, n_desc, path, message, start, duration_us, line_number.

    The first event of a span id (by line) is the span; a parent that is missing makes a root; siblings go by start,
    then line, which is the order of (start, line_number) here. Spans on or below a loop have null depth and path.
    """
    rows = spans(events)
    rows = rows.where(F.col("trace_id") == trace_id) if trace_id is not None else rows
    tree = resolve(links(rows, F.col("span_id"), F.nullif("parent_span_id", F.lit("")), F.col("trace_id"), F.col("line_number")), with_path=True)
    first = rows.groupBy("trace_id", "span_id").agg(F.min_by(F.struct("message", "span_start", "duration_us", "line_number"), "line_number").alias("_e"))
    joined = tree.select(F.col("scope").alias("trace_id"), F.col("node").alias("span_id"), F.col("parent").alias("parent_span_id"), "root", "depth", "n_desc", "path", "state")
    return joined.join(first, ["trace_id", "span_id"]).select(
        "trace_id", "span_id", "parent_span_id", "root", F.when(F.col("state") == "tree", F.col("depth")).alias("depth"), "n_desc", "path",
        F.col("_e.message").alias("message"), F.col("_e.span_start").alias("start"), F.col("_e.duration_us").alias("duration_us"), F.col("_e.line_number").alias("line_number"),
    )
