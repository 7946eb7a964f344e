"""The tables as lines and events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.constants import LEVEL_SPELLINGS, LEVEL_WORDS, RANKED_SPELLINGS
from cordwood.session import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    """log_events as delivered, with exact copies of some rows; once() and its kin take them out where it matters."""
    return table(spark, folder, "log_events")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """tail_lines as delivered."""
    return table(spark, folder, "tail_lines")


def once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """source, line_number and columns, copies once. It stands behind filters and projections, so that only what the
    result holds is exchanged; copies are exact, so rows that differ are different rows."""
    return rows.select("source", "line_number", *columns).distinct()


def once_each(rows: DataFrame) -> DataFrame:
    """rows, copies once, where they hold maps, which can't be compared; for what is left behind a filter."""
    return rows.dropDuplicates(["source", "line_number"])


def narrow(rows: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """source, line_number, columns and properties with no more than names, copies once."""
    held = once(rows, *columns, *[F.try_element_at("properties", F.lit(n)).alias(f"_p{i}") for i, n in enumerate(names)])
    return held.select("source", "line_number", *columns, F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"_p{i}"))]).alias("properties"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as one source of events: line = event_id + 1, level by type, k and user as properties."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    return e.select(
        F.lit("events").alias("source"), (F.col("event_id") + 1).alias("line_number"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("ts_offset_min"),
        F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "Warning").otherwise("Information").alias("level"),
        F.lit(None).cast("string").alias("message_template"), F.concat(F.lit("User "), user, F.lit(" "), "event_type", F.lit(" k="), k).alias("message"),
        F.lit(None).cast("string").alias("exception"), F.create_map(F.lit("UserId"), user, F.lit("EventType"), F.col("event_type"), F.lit("k"), k).alias("properties"),
        F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), "event_id", "user_id", "event_type",
    )


def span_events(spark: SparkSession, folder: str) -> DataFrame:
    """trace_spans as span events in order of row_id; ids as they are."""
    s = table(spark, folder, "trace_spans").where("start_ts is not null and trace_id is not null and span_id is not null")
    text = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    given = F.filter(F.array(F.struct(F.lit("ParentSpanId").alias("k"), F.col("parent_span_id").alias("v")), F.struct(F.lit("SpanStartTimestamp").alias("k"), text.alias("v"))), lambda p: p["v"].isNotNull())
    return s.select(
        "source", F.col("row_id").alias("line_number"), F.timestamp_micros(F.unix_micros("start_ts") + F.coalesce("duration_us", F.lit(0))).alias("ts"), "level",
        F.col("span_name").alias("message_template"), F.col("span_name").alias("message"), F.map_from_entries(given).alias("properties"), "trace_id", "span_id",
    ).dropDuplicates(["line_number"])


# ---- SQL --------------------------------------------------------------------------------------------------------

E = "e AS (SELECT * FROM log_events QUALIFY row_number() OVER (PARTITION BY source, line_number ORDER BY event_id) = 1)"
L = "l AS (SELECT * FROM tail_lines QUALIFY row_number() OVER (PARTITION BY source, line_number ORDER BY read_at) = 1)"
V = """v AS (SELECT 'events' AS source, event_id + 1 AS line_number, ts, event_id, user_id, event_type,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' ELSE 'Information' END AS level,
    props::JSON->>'$.k' AS k, 'User ' || user_id || ' ' || event_type || ' k=' || (props::JSON->>'$.k') AS message FROM events)"""
US = "epoch_us({})"


def case(column: str, pairs: dict, otherwise: str = "NULL") -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items()) + f" ELSE {otherwise} END"


def rank(column: str) -> str:
    return case(f"upper({column})", RANKED_SPELLINGS)


def normal(column: str) -> str:
    names = {s: level for level, spellings in LEVEL_SPELLINGS.items() for s in spellings}
    word = f"trim({column})"
    return f"CASE WHEN coalesce({word}, '') = '' THEN 'Information' ELSE {case(f'upper({word})', names, f'upper({word}[1:1]) || lower({word}[2:])')} END"


def guess(column: str) -> str:
    names = {s: level for level, spellings in LEVEL_SPELLINGS.items() for s in spellings}
    ranks = {w: RANKED_SPELLINGS[names[w].upper()] for w in LEVEL_WORDS}
    found = f"regexp_extract_all({column}, '(?i)\\b(" + "|".join(LEVEL_WORDS) + ")\\b')"
    return f"list_max(list_transform({found}, lambda w: {case('upper(w)', ranks)}))"


def mask(column: str) -> str:
    """The mask in a dialect without look-around: long ids by runs, numbers behind _ first."""
    out = f"coalesce({column}, '')"
    for p, m in (
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<guid>"), (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>"),
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\b", "<datetime>"), (r"\b\d{1,2}:\d{2}:\d{2}(\.\d+)?\b", "<time>"),
        (r"\"(?:[^\"\\]|\\.)*\"|''(?:[^''\\]|\\.)*''", "<str>"), (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    ):
        out = f"regexp_replace({out}, '{p}', '{m}', 'g')"
    runs = f"regexp_extract_all({out}, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+')"
    out = f"array_to_string(list_transform({runs}, lambda x: CASE WHEN regexp_full_match(x, '[0-9A-Za-z]{{8,}}') AND regexp_matches(x, '[0-9]') THEN '<id>' ELSE x END), '')"
    out = f"regexp_replace({out}, '(_)\\d+(\\.\\d+)?', '\\1<num>', 'g')"
    out = f"regexp_replace({out}, '-?\\b\\d+(\\.\\d+)?', '<num>', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def signature(template: str = "message_template", message: str = "message", names: str = "list_sort(map_keys(properties))") -> str:
    base = "coalesce(level, '') || chr(31)"
    return f"CASE WHEN coalesce({template}, '') <> '' THEN {base} || {template} ELSE {base} || {mask(message)} || chr(31) || array_to_string({names}, ',') END"
