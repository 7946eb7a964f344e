"""Field access of events: pseudo-fields, span columns, correlation ids, frames, times inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of names that carry correlation ids, in plain form (letters and digits, lower case).
ID_ENDINGS = (
    "traceid", "spanid", "parentid", "correlationid", "requestid", "reqid", "operationid", "activityid", "transactionid",
    "txid", "txnid", "sessionid", "conversationid", "messageid", "jobid", "runid", "traceparent",
)
# Names offered first for correlation, in order.
KNOWN_IDS = ("TraceId", "CorrelationId", "RequestId", "OperationId", "ActivityId", "SpanId", "TransactionId", "JobId", "SessionId")
MOST_IDS, SHORTEST_ID = 10, 3
# Where ids stand in free text.
GUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
TRACEPARENT = r"\b00-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}\b"
ID_PAIR = r"(?<![\w.\-@])([A-Za-z_@][\w.\-@]{0,48})[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9][\w\-.:/+]{2,127})"
FRAME_PLACE = r"\s+in\s+.+?:line\s+\d+$|:line\s+\d+$|\(([^():]+?)(?::\d+)+\)$"

_ISO = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,9}))?(Z|[+-][0-9]{2}:?[0-9]{2})?"
_CLOCK = r"(?<![0-9])([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,9}))?(?![0-9])"

ID_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def resolve(field: str, level: str = "level", message: str = "message", exception: str = "exception", properties: str = "properties") -> Column:
    """@Level, @Message, @Exception or a property by its exact name; null where absent."""
    special = {"@Level": level, "@Message": message, "@Exception": exception}
    return F.col(special[field]) if field in special else F.try_element_at(F.col(properties), F.lit(field))


def text_time(line: Column) -> Column:
    """First ISO-like time in a line (without offset: UTC), else a bare time of day on 2000-01-01, else null."""

    def full(m: Column) -> Column:
        """m: the match, yyyy-MM-dd, one character, HH:mm:ss, then what may follow."""
        wall = F.try_to_timestamp(F.concat(F.substring(m, 1, 10), F.lit(" "), F.substring(m, 12, 8), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))
        rest = F.substring(m, 20, 40)
        fraction = F.rpad(F.substring(F.regexp_extract(rest, "^[.,]([0-9]+)", 1), 1, 6), 6, "0").cast("long")
        offset = F.regexp_replace(F.regexp_extract(rest, "[+-][0-9:]+$", 0), ":", "")
        minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")
        shift = F.coalesce(minutes * F.when(offset.startswith("-"), -1).otherwise(1), F.lit(0)).cast("long") * 60_000_000
        return F.when(m != "", F.timestamp_micros(F.unix_micros(wall) + fraction - shift))

    def clock(m: Column) -> Column:
        at = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.substring(m, 1, 8), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))
        fraction = F.rpad(F.substring(F.regexp_extract(m, "[.,]([0-9]+)$", 1), 1, 6), 6, "0").cast("long")
        return F.when(m != "", F.timestamp_micros(F.unix_micros(at) + fraction))

    # the line is searched once for each form; the parts are taken from the short match
    found = F.transform(F.array(F.regexp_extract(line, _ISO, 0)), full)
    bare = F.transform(F.array(F.regexp_extract(line, _CLOCK, 0)), clock)
    return F.coalesce(F.get(found, F.lit(0)), F.get(bare, F.lit(0)))


def top_frame(exception: Column) -> Column:
    """Method of the first 'at ...(' line of an exception text, null without one."""
    return F.nullif(F.trim(F.regexp_extract(exception, r"(?m)^\s*at\s+(.+?)\(", 1)), F.lit(""))


def normalize_frame(frame: Column) -> Column:
    """A frame without source line; other digits become #."""
    bare = F.regexp_replace(frame, FRAME_PLACE, "\u0001$1\u0002")
    bare = F.regexp_replace(F.regexp_replace(bare, "\u0001\u0002", ""), "\u0001(.*)\u0002", "($1)")
    return F.trim(F.regexp_replace(bare, r"\d+", "#"))


def is_correlation_key(name: Column) -> Column:
    """Whether a property name, letters and digits of it, ends as names of ids do."""
    plain = F.substring(F.lower(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", "")), 1, 64)
    return plain.rlike("(?:" + "|".join(ID_ENDINGS) + ")$")


def correlation_ids(text: Column, trace_id: Column, span_id: Column, properties: Column) -> Column:
    """At most ten ids (name, value) of an event and its text, in order of the places they are looked for: trace and
    span, id-like properties (by name), traceparent headers, pairs with an id-like key, guids. Values are compared
    without letter case; values of fewer than three characters are none."""
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(ID_TYPE)
    entries = F.array_sort(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))))
    from_properties = F.transform(F.filter(entries, lambda e: is_correlation_key(e["key"])), lambda e: pair(e["key"], e["value"]))
    traces = F.flatten(F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(TRACEPARENT), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(TRACEPARENT), F.lit(2)).alias("s")),
        lambda z: F.array(pair(F.lit("TraceId"), z["t"]), pair(F.lit("SpanId"), z["s"])),
    ))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ID_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(ID_PAIR), F.lit(2)).alias("v"))
    pairs = F.transform(
        F.filter(pairs, lambda z: is_correlation_key(z["k"])),
        lambda z: pair(F.regexp_replace(z["k"], "^[@\"']+|[@\"']+$", ""), F.regexp_replace(z["v"], "[.:,/]+$", "")),
    )
    guids = F.transform(F.regexp_extract_all(text, F.lit(GUID), F.lit(0)), lambda g: pair(F.lit("GUID"), g))
    every = F.concat(F.array(pair(F.lit("TraceId"), trace_id), pair(F.lit("SpanId"), span_id)), from_properties, traces, pairs, guids)
    real = F.filter(every, lambda x: (F.trim(x["value"]) != "") & (F.length(x["value"]) >= SHORTEST_ID))
    kept = F.aggregate(
        real, none,
        lambda have, x: F.when(F.exists(have, lambda h: F.lower(h["value"]) == F.lower(x["value"])), have).otherwise(F.concat(have, F.array(x))),
    )
    return F.slice(kept, 1, MOST_IDS)


def suggest_fields(properties: Column) -> Column:
    """Property names that look like correlation ids: known names in their order, then names ending in Id or Guid."""
    names = F.array_sort(F.map_keys(properties))
    known = F.array(*map(F.lit, KNOWN_IDS))
    first = F.flatten(F.transform(known, lambda k: F.slice(F.filter(names, lambda n: F.lower(n) == F.lower(k)), 1, 1)))
    others = F.filter(names, lambda n: F.lower(n).rlike("(?:id|guid)$") & ~F.exists(known, lambda k: F.lower(k) == F.lower(n)))
    ordered = F.transform(F.array_sort(F.transform(others, lambda n: F.struct(F.lower(n).alias("l"), n.alias("n")))), lambda s: s["n"])
    return F.concat(first, ordered)


def with_span_columns(events):
    """events with parent_span_id, span_kind, span_start, is_span and duration_us."""
    prop = lambda n: F.try_element_at("properties", F.lit(n))
    start = F.try_to_timestamp(prop("SpanStartTimestamp"))
    found = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & start.isNotNull()
    return events.withColumns({
        "parent_span_id": prop("ParentSpanId"), "span_kind": prop("SpanKind"), "span_start": start, "is_span": found,
        "duration_us": F.when(found, F.unix_micros("ts") - F.unix_micros(start)),
    })
