"""Most frequent shapes, values and properties of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.functions.fields import resolve, top_frame
from cordwood.functions.levels import severity
from cordwood.functions.masking import signature


def with_signature(events: DataFrame) -> DataFrame:
    """events with their signature, unless they have one already."""
    if "signature" in events.columns:
        return events
    return events.withColumn("signature", signature(F.col("level"), F.col("message_template"), F.col("message"), F.col("properties")))


def at_least(min_level: str | None) -> Column:
    """Whether an event's level has the rank of min_level or more; without one all have, unranked events rank below all."""
    return F.lit(True) if min_level is None else F.coalesce(severity(F.col("level")), F.lit(-1)) >= severity(F.lit(min_level))


def _summary(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """Combined before the shuffle: counts, and the events of the first and last line by place, not by time."""
    place = F.struct("line_number", "source")
    first, last = F.struct(place.alias("p"), "ts", "level", "message"), F.struct(place.alias("p"), "ts")
    return rows.groupBy(key).agg(F.count("*").alias("count"), F.min_by(first, place).alias("_f"), F.max_by(last, place).alias("_l"), *more)


def top_patterns(events: DataFrame, min_level: str | None = None, n: int = 10) -> DataFrame:
    """The n most frequent signatures: count, level and message of the first event, first and last line and their times
    (which may be null, and need not be the earliest or latest). Ties: the one seen first.

    Any number of signatures is tracked; the result is the top of all.
    """
    rows = with_signature(events.where(at_least(min_level)))
    top = _summary(rows, "signature").orderBy(F.desc("count"), "_f.p.line_number", "signature").limit(n)
    return top.select(
        "signature", "count", F.col("_f.level").alias("level"), F.col("_f.message").alias("sample_message"), F.col("_f.p.line_number").alias("first_line"),
        F.col("_l.p.line_number").alias("last_line"), F.col("_f.ts").alias("first_ts"), F.col("_l.ts").alias("last_ts"),
    )


def sample_lines(events: DataFrame, patterns: DataFrame, key: str = "signature", n: int = 3) -> DataFrame:
    """key, sample_lines: the first n line numbers of each pattern of a top list."""
    rows = with_signature(events).join(patterns.select(key), key, "left_semi")
    by_line = rows.groupBy(key, F.col("line_number")).agg(F.count("*").alias("_n"))
    ranked = by_line.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("line_number"))).where(F.col("_r") <= n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("line_number")).alias("sample_lines"))


def pattern_occurrences(events: DataFrame, wanted: str, n: int) -> DataFrame:
    """The first n events of a signature."""
    return with_signature(events).where(F.col("signature") == wanted).orderBy("line_number", "source").limit(n)


def top_values(events: DataFrame, field: str, min_level: str | None = None, frame_fallback: bool = False, n: int = 10) -> DataFrame:
    """The n most frequent values of a field, with the number of distinct signatures under each and the three of them
    seen first. Null and blank values are skipped; with frame_fallback they are replaced by the top frame of the
    exception."""
    value = F.when(F.trim(resolve(field)) != "", resolve(field))
    if frame_fallback:
        value = F.coalesce(value, top_frame(F.col("exception")))
    rows = with_signature(events.where(at_least(min_level))).withColumn("value", value).where("value is not null")
    shapes = rows.groupBy("value", "signature").agg(
        F.count("*").alias("_n"), F.min(F.struct("line_number", "source", "ts", "level", "message")).alias("_f"), F.max(F.struct("line_number", "source", "ts")).alias("_l")
    )
    top = shapes.groupBy("value").agg(
        F.sum("_n").alias("count"), F.count("*").alias("signatures"), F.min("_f").alias("_f"), F.max("_l").alias("_l")
    ).orderBy(F.desc("count"), "_f.line_number", "value").limit(n)
    # the signatures of the few values on top, each once, ranked by the place where it was seen first
    seen = shapes.join(top.select("value"), "value", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("value").orderBy("_f.line_number", "_f.source"))).where("_r <= 3")
    firsts = seen.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "signature"))), lambda x: x["signature"]).alias("first_signatures"))
    return top.join(firsts, "value").orderBy(F.desc("count"), "_f.line_number", "value").select(
        "value", "count", "signatures", "first_signatures", F.col("_f.level").alias("level"), F.col("_f.message").alias("sample_message"),
        F.col("_f.line_number").alias("first_line"), F.col("_l.line_number").alias("last_line"), F.col("_f.ts").alias("first_ts"), F.col("_l.ts").alias("last_ts"),
    )


def top_error_sources(events: DataFrame, field: str = "SourceContext", min_level: str = "Error", n: int = 10) -> DataFrame:
    return top_values(events, field, min_level, True, n)


def property_usage(events: DataFrame, names: Column | None = None) -> DataFrame:
    """name, events: how many events carry each property, most first, then by name without letter case. names: the
    names of an event's properties, if there is no column properties."""
    names = events.select(F.explode(F.map_keys("properties") if names is None else names).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("events")).orderBy(F.desc("events"), F.lower("name"), "name")


def list_properties(events: DataFrame, sample: int = 2000, names: Column | None = None) -> DataFrame:
    """Names of the properties of the first events (at most 20 000 of them)."""
    first = events.orderBy("line_number", "source").limit(min(sample, 20_000))
    return first.select(F.explode(F.map_keys("properties") if names is None else names).alias("name")).distinct().orderBy("name")


def level_counts(events: DataFrame) -> DataFrame:
    """errors (Error and above), warnings, total."""
    rank = severity(F.col("level"))
    return events.agg(F.count_if(rank >= 4).alias("errors"), F.count_if(rank == 3).alias("warnings"), F.count("*").alias("total"))


def line_rate(rows: DataFrame, at: str = "read_at") -> DataFrame:
    """second, lines: lines of each second."""
    return rows.where(F.col(at).isNotNull()).groupBy(F.date_trunc("second", at).alias("second")).agg(F.count("*").alias("lines"))
