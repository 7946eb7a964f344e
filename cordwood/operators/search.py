"""Search, filters and named views over lines and events."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.constants import LEVELS
from cordwood.formats.read import parse
from cordwood.functions.fields import resolve, text_time
from cordwood.functions.levels import line_severity
from cordwood.functions.ordered import running
from cordwood.functions.timequery import parse_time_query

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def valid_pattern(pattern: str) -> bool:
    """Whether the JVM can compile a pattern; checked before planning, since a bad one fails the job."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern) if spark else re.compile(pattern)
    except Exception:  # the gateway wraps PatternSyntaxException
        return False
    return True


def line_matcher(pattern: str, regex: bool = False, case: bool = False) -> Callable[[Column], Column]:
    """A predicate over a text column; raises ValueError for an empty or invalid pattern. A pattern without any
    special character is a plain substring, whatever it is given as."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if not regex or not _META.search(pattern):
        return (lambda c: F.contains(c, F.lit(pattern))) if case else (lambda c: F.contains(F.lower(c), F.lit(pattern.lower())))
    whole = ("(?U)" if case else "(?iuU)") + pattern
    if not valid_pattern(whole):
        raise ValueError(f"invalid pattern: {pattern}")
    return lambda c: c.rlike(whole)


def search(lines: DataFrame, pattern: str, regex: bool = False, case: bool = False, prop: str | None = None) -> DataFrame:
    """Lines that match; an empty pattern gives none. With prop only lines of structured JSON events count, by that
    field. Null texts match nothing."""
    if not pattern:
        return lines.limit(0)
    matches = line_matcher(pattern, regex, case)
    if prop is None:
        return lines.where(matches(F.col("text")))
    hits = parse(lines, "serilog").where(matches(resolve(prop))).select("source", "line_number")
    return lines.join(hits, ["source", "line_number"], "left_semi")


def find_next(lines: DataFrame, line_number: int, forward: bool, matches: Callable[[Column], Column], wrap: bool = True) -> DataFrame:
    """line_number of the next hit after (before) a line, if need be from the other end; null if there is none."""
    hit = matches(F.col("text"))
    n = F.col("line_number")
    ahead, any_ = (F.min, F.min) if forward else (F.max, F.max)
    found = lines.agg(ahead(F.when(hit & ((n > line_number) if forward else (n < line_number)), n)).alias("_a"), any_(F.when(hit, n)).alias("_b"))
    return found.select((F.coalesce("_a", "_b") if wrap else F.col("_a")).alias("line_number"))


def count_matches(lines: DataFrame, matches: Callable[[Column], Column], once: list[str] | None = None) -> DataFrame:
    """n: the number of hits. Where lines may have been delivered twice, once names their key: only the keys of hits
    are exchanged."""
    if once is None:
        return lines.agg(F.count_if(matches(F.col("text"))).alias("n"))
    return lines.where(matches(F.col("text"))).select(*once).distinct().agg(F.count("*").alias("n"))


# ---- effective times --------------------------------------------------------------------------------------------


def with_effective_ts(lines: DataFrame, own: Column | None = None) -> DataFrame:
    """lines with own_ts and effective_ts: the own time, else the last one above it in its source."""
    own = text_time(F.col("text")) if own is None else own
    return running(lines.withColumn("own_ts", own), ["source"], "line_number", lasts={"effective_ts": F.col("own_ts")})


def with_delta(lines: DataFrame, reference: dt.datetime | None = None) -> DataFrame:
    """lines (with effective times) with delta_us: own time less the effective time of the line above, or less a fixed
    reference; null for lines without own time and for the first."""
    if reference is not None:
        return lines.withColumn("delta_us", F.unix_micros("own_ts") - F.unix_micros(F.lit(reference)))
    rows = running(lines, ["source"], "line_number", previous={"_before": F.col("effective_ts")})
    return rows.withColumn("delta_us", F.unix_micros("own_ts") - F.unix_micros("_before")).drop("_before")


def time_range(lines: DataFrame, start: dt.datetime | None, end: dt.datetime | None, most: int | None = None) -> DataFrame:
    """The stretch of each source from the first line with a time of start or later up to the line before the first
    later one past end; lines without time inside it belong to it. With most, that many lines in line order."""
    timed = lines if "own_ts" in lines.columns else with_effective_ts(lines)
    n, own = F.col("line_number"), F.col("own_ts")
    lo = timed.groupBy("source").agg(F.min(F.when(own >= F.lit(start), n) if start else n).alias("_lo")).where("_lo is not null")
    held = timed.join(lo, "source").where(n >= F.col("_lo"))
    if end is not None:
        hi = held.groupBy("source").agg(F.min(F.when((n > F.col("_lo")) & (own > F.lit(end)), n)).alias("_hi"))
        held = held.join(hi, "source").where(F.col("_hi").isNull() | (n < F.col("_hi"))).drop("_hi")
        held = held.where((n > F.col("_lo")) | ~F.coalesce(own > F.lit(end), F.lit(False)))
    held = held.drop("_lo")
    return held.orderBy("source", "line_number").limit(most) if most is not None else held


def latest_ts(lines: DataFrame, tail: int = 500) -> DataFrame:
    """source, ts: the time of the last line with one among the last tail lines of each source."""
    timed = lines if "own_ts" in lines.columns else lines.withColumn("own_ts", text_time(F.col("text")))
    ends = timed.groupBy("source").agg(F.max("line_number").alias("_end"))
    near = timed.join(ends, "source").where((F.col("line_number") > F.col("_end") - tail) & F.col("own_ts").isNotNull())
    return near.groupBy("source").agg(F.max_by("own_ts", "line_number").alias("ts"))


# ---- views ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterView:
    """A named conjunction of filters; whatever is unset holds for all lines. Times stay as they were typed."""

    name: str = ""
    text: str | None = None
    regex: bool = True
    case: bool = False
    exclude: bool = False
    min_level: str | None = None
    field: str | None = None
    value: str | None = None
    correlation: str | None = None
    time_from: str | None = None
    time_to: str | None = None
    hide_before: int | None = None
    collapsed: bool = False
    reference: dt.datetime | None = None

    def predicate(self, columns: list[str], timed: bool | None = None) -> Column:
        """Over events with text, effective_ts (for times) and head_line (for collapsed ones). timed: only the part
        that looks at times (True) or only the rest (False)."""
        return reduce(lambda a, b: a & b, (self._times() if timed is not False else []) + (self._own(columns) if timed is not True else []), F.lit(True))

    def _own(self, columns: list[str]) -> list[Column]:
        parts: list[Column] = []
        if self.text:
            try:
                hit = line_matcher(self.text, self.regex, self.case)(F.col("text"))
                parts.append(~hit if self.exclude else hit)
            except ValueError:
                pass  # an invalid pattern shows every line, in exclude mode too
        if self.min_level is not None:
            structured = F.col("level") if "level" in columns else F.lit(None).cast("string")
            parts.append(F.coalesce(line_severity(structured, F.lit(None).cast("string"), F.col("text")) >= LEVELS.index(self.min_level), F.lit(False)))
        if self.field is not None:
            parts.append(F.coalesce(resolve(self.field) == F.lit(self.value), F.lit(False)))
        if self.correlation:
            parts.append(F.contains(F.lower("text"), F.lit(self.correlation.lower())))
        if self.hide_before is not None:
            parts.append(F.col("line_number") >= self.hide_before)
        if self.collapsed:
            parts.append(F.col("head_line").isNull())
        return parts

    def _times(self) -> list[Column]:
        parts: list[Column] = []
        for bound, later in ((self.time_from, False), (self.time_to, True)):
            at = parse_time_query(bound, self.reference) if bound else None
            if at is not None:
                inside = F.col("effective_ts") <= F.lit(at) if later else F.col("effective_ts") >= F.lit(at)
                parts.append(F.coalesce(inside, F.lit(False)))
        return parts

    def renamed(self, name: str) -> FilterView:
        return replace(self, name=name)


def apply_filters(rows: DataFrame, view: FilterView) -> DataFrame:
    return rows.where(view.predicate(rows.columns))


def filtered(rows: DataFrame, view: FilterView, own: Column) -> DataFrame:
    """rows that pass a view, own being their own time. Texts are looked at where they lie; only line numbers and times
    of all rows move to find the effective times, and these meet the rows that are left."""
    left = rows.where(view.predicate(rows.columns, False))
    if not view.time_from and not view.time_to:
        return left
    times = with_effective_ts(rows.select("source", "line_number", own.alias("_own")).distinct(), F.col("_own")).where(view.predicate([], True))
    return left.join(times.select("source", "line_number"), ["source", "line_number"], "left_semi")


def filter_correlation(lines: DataFrame, value: str) -> DataFrame:
    """Lines of any source that hold an id, without letter case."""
    return lines.where(F.contains(F.lower("text"), F.lit(value.lower())))


# ---- event channels ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class EventRule:
    pattern: str
    field: str = "Message"  # Message, Provider or Level
    provider: str | None = None
    ignore_case: bool = True
    enabled: bool = True


def event_log_filter(rules: list[EventRule], message: str = "message", provider: str = "provider", level: str = "level") -> Column:
    """True where any enabled rule matches, or if none is enabled; rules with an invalid pattern match nothing."""
    enabled = [r for r in rules if r.enabled]
    if not enabled:
        return F.lit(True)
    out = F.lit(False)
    for r in enabled:
        pattern = ("(?iuU)" if r.ignore_case else "(?U)") + r.pattern
        if not valid_pattern(pattern):
            continue
        hit = F.coalesce(F.col({"Message": message, "Provider": provider, "Level": level}[r.field]), F.lit("")).rlike(pattern)
        if r.provider:
            hit = hit & F.coalesce(F.lower(F.col(provider)) == r.provider.lower(), F.lit(False))
        out = out | hit
    return out


def search_event_log(rows: DataFrame, rules: list[EventRule], pattern: str, regex: bool = False, case: bool = False, order: str = "record_id") -> DataFrame:
    """Rows that pass the rules and hold the pattern, with line_number: the place among those that pass the rules, by
    order, a whole number."""
    passing = running(rows.where(event_log_filter(rules)).drop("line_number"), ["source"], order, sums={"line_number": F.lit(1)})
    return passing.where(line_matcher(pattern, regex, case)(F.col("text"))) if pattern else passing.limit(0)


# ---- caps and cursors -------------------------------------------------------------------------------------------

HARD_CAP, CONFIGURED_CAP = 500, 200


def clamp_rows(n: int, configured: int = CONFIGURED_CAP) -> int:
    return max(1, min(n, min(configured, HARD_CAP)))


def cap(rows: DataFrame, n: int, *order: Column | str) -> tuple[DataFrame, bool]:
    """(the first n rows by order, whether there were more)."""
    first = rows.orderBy(*order).limit(n + 1)
    return first.limit(n), first.count() > n


def new_lines_since(lines: DataFrame, cursor: int, n: int) -> DataFrame:
    """The n lines after a cursor: 0 is the start, -1 the tail, and one past the end (a file that was reset) the start."""
    total = lines.agg(F.max("line_number")).first()[0] or 0
    start = max(0, total - n) if cursor == -1 else 0 if cursor > total else cursor
    return lines.where(F.col("line_number") > start).orderBy("line_number").limit(n)
