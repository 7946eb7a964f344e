"""Several line sources as one, in order of time."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.fields import text_time
from cordwood.functions.ordered import numbered, running

MARK = "│"


def assign_labels(paths: list[str]) -> list[str]:
    """File names without extension; from the second of a name on with #2, #3 ..."""
    seen: Counter = Counter()
    out = []
    for p in paths:
        name = PurePath(re.split(r"[\\/]", p)[-1]).stem
        seen[name.lower()] += 1
        out.append(name if seen[name.lower()] == 1 else f"{name}#{seen[name.lower()]}")
    return out


def strip_label(text: Column) -> Column:
    return F.regexp_replace(text, f"^[^{MARK}]*{MARK} ?", "")


def with_keys(lines: DataFrame, time: Column | None = None) -> DataFrame:
    """lines with merge_key: the line's own time, else that last seen in its source, else null (first of all)."""
    own = text_time(F.col("text")) if time is None else time
    return running(lines, ["source"], "line_number", lasts={"merge_key": own})


def merge(lines: DataFrame, labels: dict[str, str] | None = None, time: Column | None = None) -> DataFrame:
    """line_number (1..n over all), text ('label│ text'), source, source_line, merge_key, in order of key, source, line.

    The numbers come from a range-partitioned sort: counts of each range first, then each line's place in its own.
    """
    keyed = with_keys(lines, time)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col("source")), F.col("source")) if labels else F.col("source")
    rows = keyed.withColumnRenamed("line_number", "source_line")
    placed = numbered(rows, "line_number", [F.col("merge_key").asc_nulls_first(), F.col("source").asc(), F.col("source_line").asc()])
    return placed.select("line_number", F.concat(label, F.lit(f"{MARK} "), F.col("text")).alias("text"), "source", "source_line", "merge_key")
