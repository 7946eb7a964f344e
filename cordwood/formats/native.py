"""Formats that need no Python: syslog, W3C extended, plain text. Lines in, events out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.constants import LEVELS
from cordwood.formats.schema import EVENT_COLUMNS
from cordwood.functions.fields import text_time
from cordwood.functions.levels import guess_severity, http_level, syslog_level
from cordwood.functions.ordered import running
from cordwood.functions.plan import fenced

# The two syslog layouts.
RFC5424 = r"(?s)^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+)(?: (.*))?$"
RFC3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+(?:\[\d+\])?):?\s*(.*)$"
SD_PARAM = r"([A-Za-z0-9_.-]+)=\"((?:[^\"\\]|\\.)*)\""
_ROW = r"\"[^\"]*\"?|[^ ]+"


def _event(**given: Column) -> list[Column]:
    kinds = {"ts": "timestamp", "ts_offset_min": "int", "properties": "map<string,string>"}
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in EVENT_COLUMNS]


def _map(*pairs: tuple[str, Column]) -> Column:
    """Pairs whose value is neither null, empty nor -."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["value"] != "-")))


def _merged(a: Column, b: Column) -> Column:
    """Two maps as one; b's values win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))


def parse_syslog(lines: DataFrame, year: int = 1970) -> DataFrame:
    """Events of both syslog layouts, lines of neither left out. The older one names no year: it is given."""
    t = F.col("text")
    keep = [c for c in ("source", "line_number") if c in lines.columns]
    is_new, is_old = t.rlike(RFC5424), t.rlike(RFC3164)
    # each line is taken apart once; the message comes last and may hold the separator
    apart = F.when(is_new, F.regexp_replace(t, RFC5424, "\u0001".join(f"${i}" for i in range(1, 10)))).when(
        is_old, F.regexp_replace(t, RFC3164, "\u0001".join(f"${i}" for i in range(1, 6)))
    )
    rows = fenced(lines.select(*keep, "text"), _new=is_new, _f=F.split(apart, "\u0001", 9)).where("_f is not null")
    rows = fenced(rows, _f=F.when(F.col("_new"), F.col("_f")).otherwise(F.concat(F.slice("_f", 1, 4), F.array(F.array_join(F.slice(F.col("_f"), F.lit(5), F.greatest(F.size("_f") - 4, F.lit(1))), "\u0001")))))
    new = old = lambda i: F.get("_f", F.lit(i - 1))
    pri = new(1).cast("int")
    params = F.regexp_extract_all(new(8), F.lit(SD_PARAM), F.lit(1)), F.regexp_extract_all(new(8), F.lit(SD_PARAM), F.lit(2))
    listed = F.arrays_zip(params[0].alias("key"), params[1].alias("value"))
    every = F.map_from_entries(listed)
    merged = F.aggregate(
        listed, F.create_map().cast("map<string,string>"), lambda m, e: _merged(m, F.create_map(e["key"], e["value"]))
    )
    last = F.when(F.size(F.array_distinct(params[0])) == F.size(params[0]), every).otherwise(merged)
    facility = F.floor(pri / 8).cast("string")
    p_new = _merged(_map(("facility", facility), ("host", new(4)), ("appname", new(5)), ("procid", new(6)), ("msgid", new(7))), last)
    p_old = _map(("facility", facility), ("host", old(3)), ("tag", old(4)))
    stamp = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(old(2), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return rows.select(*keep, *_event(
        ts=F.when(F.col("_new"), text_time(new(3))).otherwise(stamp),
        ts_offset_min=F.when(F.col("_new") & ~new(3).rlike("[+-][0-9]{2}:?[0-9]{2}$"), 0),
        level=syslog_level(pri % 8),
        message=F.when(F.col("_new"), F.regexp_replace(new(9), "^﻿+", "")).otherwise(old(5)),
        properties=F.when(F.col("_new"), p_new).otherwise(p_old),
    ))


def parse_w3c(lines: DataFrame) -> DataFrame:
    """Events of W3C extended logs. The last #Fields line above a row names its columns; - is empty, quoted values may
    hold blanks, and rows with fewer values than columns are left out.

    Headers are carried down their source over chunks of it.
    """
    t = F.col("text")
    header = F.when(t.rlike(r"(?i)^#\s*fields\s*:"), F.filter(F.split(F.regexp_replace(t, "^[^:]*:", ""), " "), lambda x: F.trim(x) != ""))
    rows = running(lines.select("source", "line_number", "text"), ["source"], "line_number", lasts={"_names": header})
    rows = rows.where(~t.startswith("#") & (t != "") & F.col("_names").isNotNull())
    values = F.transform(F.regexp_extract_all(t, F.lit(_ROW), F.lit(0)), lambda v: F.regexp_replace(F.regexp_replace(v, '^"', ""), '"$', ""))
    rows = fenced(rows, _v=F.transform(values, lambda v: F.when(v == "-", "").otherwise(v))).where(F.size("_v") >= F.size("_names"))
    rows = fenced(rows, properties=F.map_from_arrays("_names", F.slice(F.col("_v"), F.lit(1), F.size("_names"))))
    p = lambda n: F.try_element_at("properties", F.lit(n))
    some = lambda n: F.nullif(p(n), F.lit(""))
    target = F.when(some("cs-uri-query").isNull(), some("cs-uri-stem")).otherwise(F.concat(some("cs-uri-stem"), F.lit("?"), some("cs-uri-query")))
    message = F.concat_ws(" ", some("cs-method"), target, F.concat(F.lit("→ "), some("sc-status")), F.concat(F.lit("("), some("time-taken"), F.lit(" ms)")))
    stamp = F.try_to_timestamp(F.concat(p("date"), F.lit("T"), p("time"), F.lit("Z")))
    return rows.select("source", "line_number", *_event(
        ts=stamp, ts_offset_min=F.when(stamp.isNotNull(), 0),
        level=F.coalesce(p("x-level"), p("level"), http_level(p("sc-status").try_cast("int")), F.lit("Information")), message=message, properties=F.col("properties"),
    ))


def parse_plain(lines: DataFrame) -> DataFrame:
    """Every line that is not blank: its most severe level word, the first time in it, the line as message."""
    t = F.col("text")
    rank = guess_severity(t)
    at = text_time(t)
    keep = [c for c in ("source", "line_number") if c in lines.columns]
    return lines.where(F.trim(t) != "").select(*keep, *_event(
        ts=at, ts_offset_min=F.when(at.isNotNull(), 0), level=F.get(F.array(*map(F.lit, LEVELS)), rank), message=t, properties=F.create_map().cast("map<string,string>"),
    ))


