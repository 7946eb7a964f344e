"""Volume over time: bins, spikes, novelty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood import constants as K
from cordwood.functions.masking import mask


def choose_bucket(span_us: int, target: int = K.TARGET_BINS) -> int:
    """The smallest natural width in microseconds that gives a span at most target bins."""
    return next((w * 1000 for w in K.NICE_WIDTHS_MS if span_us / (w * 1000) <= target), K.NICE_WIDTHS_MS[-1] * 1000)


def volume_bins(samples: DataFrame, bucket_us: int | None = None, max_bins: int = K.MAX_BINS) -> DataFrame:
    """bin, start_us, width_us, total, warnings, errors, first_line, last_line: bins from the earliest time on, gaps
    included (-1 for their lines). samples: ts, severity, line_number; rows without time are left out.

    Empty without two distinct times. Only the span is read ahead; the bins, at most max_bins + 1, are counted in one
    aggregation. Widths are kept in ticks of 100 ns, as a capped width need not be whole microseconds.
    """
    rows = samples.where("ts is not null").select(F.unix_micros("ts").alias("_us"), "severity", "line_number")
    lo, hi = rows.agg(F.min("_us"), F.max("_us")).first()
    spark = samples.sparkSession
    schema = "bin long, start_us long, width_us double, total long, warnings long, errors long, first_line long, last_line long"
    width = bucket_us if bucket_us is not None else None if lo is None else choose_bucket(hi - lo)
    if lo is None or hi <= lo or width <= 0:
        return spark.createDataFrame([], schema)
    ticks = width * 10
    if (hi - lo) * 10 // ticks + 1 > max_bins:
        ticks = math.ceil((hi - lo) * 10 / max_bins)
    place = F.struct("_us", "line_number")
    counted = rows.groupBy(F.floor((F.col("_us") - lo) * 10 / ticks).alias("bin")).agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == 3).alias("warnings"), F.count_if(F.col("severity") >= 4).alias("errors"),
        F.min_by("line_number", place).alias("first_line"), F.max_by("line_number", place).alias("last_line"),
    )
    last = (hi - lo) * 10 // ticks
    every = spark.range(last + 1).withColumnRenamed("id", "bin")
    none = {"total": 0, "warnings": 0, "errors": 0, "first_line": -1, "last_line": -1}
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.lit(lo) + F.floor(F.col("bin") * ticks / 10)).cast("long").alias("start_us"), F.lit(ticks / 10).alias("width_us"),
        *[F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in none.items()],
    )


def volume_spikes(
    bins: DataFrame, sigmas: float = K.SPIKE_SIGMAS, window: int = K.SPIKE_WINDOW, history: int = K.SPIKE_HISTORY,
    min_total: int = K.SPIKE_MIN_TOTAL, min_errors: int = K.SPIKE_MIN_ERRORS,
) -> DataFrame:
    """bins with is_volume_spike and is_error_spike, each against the window bins before it. The window is not
    partitioned: it runs over bins, of which there are at most a few hundred."""
    past = W.orderBy("bin").rowsBetween(-window, -1)
    n = F.count("*").over(past)

    def spike(c: str, least: int, floor: float) -> Column:
        limit = F.avg(c).over(past) + sigmas * F.greatest(F.stddev_pop(c).over(past), F.lit(floor))
        return F.coalesce((n >= history) & (F.col(c) >= least) & (F.col(c) > limit), F.lit(False))

    return bins.withColumns({"is_volume_spike": spike("total", min_total, 1.0), "is_error_spike": spike("errors", min_errors, 0.5)})


def new_patterns(events: DataFrame, warmup: int = K.NOVELTY_WARMUP, min_severity: int = K.NOVELTY_SEVERITY) -> DataFrame:
    """Events that are the first of their severity and masked message in their source, past the source's first warmup
    events, of at least min_severity. events: source, line_number, message, severity. Every event counts towards the
    warm-up, whatever its severity and also without one; copies of a line count once.

    The first event of each shape is found by an aggregation, not by sorting shapes; an event's place in its source is
    counted over chunks of lines, from line numbers alone.
    """
    grave = events.where(F.col("severity") >= min_severity).withColumn("shape", mask(F.col("message")))
    first = grave.groupBy("source", "severity", "shape").agg(F.min(F.struct("line_number", "message")).alias("_f"))
    seen = events.where("line_number is not null").select("source", "line_number").distinct()
    chunk = F.floor(F.col("line_number") / 65536)
    counts = seen.groupBy("source", chunk.alias("_c")).agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    early = base.where(F.col("_base") <= warmup).select("source", "_c", "_base")
    inside = seen.withColumn("_c", chunk).join(early, ["source", "_c"])
    place = inside.withColumn("_place", F.col("_base") + F.row_number().over(W.partitionBy("source", "_c").orderBy("line_number")))
    warm = place.where(F.col("_place") <= warmup).groupBy("source").agg(F.max("line_number").alias("_warm"))
    return first.join(warm, "source", "left").where(F.col("_f.line_number") > F.coalesce("_warm", F.lit(0))).select(
        "source", F.col("_f.line_number").alias("line_number"), "severity", "shape", F.col("_f.message").alias("message")
    )
